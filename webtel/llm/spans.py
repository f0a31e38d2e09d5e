"""Spans of pattern matches in DataFrame functions: half-open, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches, as an array of strings; empty where `when` is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if when is None else F.when(when, found).otherwise(F.array().cast("array<string>"))


def located(text: Column, pattern: str, found: Column, keep: Callable[[Column], Column]) -> Column:
    """Structs (start, end, value) of those of the matches `found` that `keep` accepts.

    The texts between matches give the positions: each match starts where
    the lengths of all before it add up to.
    """
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("got"))

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"]), F.array_append(acc["got"], span)).otherwise(acc["got"]).alias("got"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, add, lambda a: a["got"])).otherwise(F.array().cast(EMPTY))


def named(spans: Column, kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
