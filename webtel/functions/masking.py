"""Masking of host names and path segments: parts that may identify someone become a mark.

What is judged is the percent-decoded text, where there is one: coordinates,
typed searches and stretches that look like identifiers go. The stretches of
a distinct text are judged in one numpy step each, from sums over its
prefixes; everything around that is columns. A list of the encoded form of
each character carries the spans back to the text as it was written.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.functions.classify import KNOWN, IdentifierModel
from webtel.functions.urls import SUFFIXES, decode_component, let, registrable_domain

#: The mark; from which length texts are cut, and what is kept of them; the shortest masked stretch; the
#: shortest typed search; gaps between masks and rests behind the last one that are too short to be worth keeping.
MARK, MOST, SHORTEST, SEARCH, GAP, TAIL = "#??#", 128, 8, 12, 6, 8
#: Fixed value: most words of the part in front that is judged word by word.
PREFIX_WORDS = 10
#: Lower-case letters of scripts, and how many in a row make a word that is no identifier.
SCRIPTS = (("a", "z", 6), ("α", "ω", 3), ("؀", "ۿ", 3), ("ა", "ჿ", 3), ("а", "џ", 4), ("ա", "և", 3))
_PREFIX = "^(?:[" + "".join(f"{a}-{b}" for a, b, _ in SCRIPTS) + f"]+-){{0,{PREFIX_WORDS}}}"
_UUID = re.compile("(?=[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", re.I)
_TAIL_BYTE = "%[89ABab][0-9A-Fa-f]"
#: One character as it stands in a URL: percent-encoded UTF-8, or itself.
_UNIT = "|".join(
    [
        "%[0-7][0-9A-Fa-f]",
        f"%(?:[Cc][2-9A-Fa-f]|[Dd][0-9A-Fa-f]){_TAIL_BYTE}",
        f"%(?:[Ee]0%[ABab][0-9A-Fa-f]|[Ee][Dd]%[89][0-9A-Fa-f]|[Ee][1-9A-Ca-cEeFf]{_TAIL_BYTE}){_TAIL_BYTE}",
        f"%[Ff](?:0%[9ABab][0-9A-Fa-f]|[1-3]{_TAIL_BYTE}|4%8[0-9A-Fa-f]){_TAIL_BYTE}{_TAIL_BYTE}",
        "[^%]",
    ]
)


class Stretches:
    """Sums over the prefixes of a text, from which any of its stretches is judged."""

    def __init__(self, text: str, model: IdentifierModel):
        self.model = model
        code = np.array([ord(c) for c in text], dtype=np.int64)
        low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text], dtype=np.int64)
        self.code, self.n = code, len(text)
        letter, digit = (low >= 97) & (low <= 122), (low >= 48) & (low <= 57)
        self.letters, self.digits = self._sums(letter), self._sums((code >= 48) & (code <= 57))
        self.hex = self._sums(digit | (low >= 97) & (low <= 102))
        self.vowels = self._sums(np.isin(low, [ord(c) for c in "aeiou"]))
        self.crosses = self._sums(code == ord("x"))
        self.odd = self._sums(~np.isin(code, [ord(c) for c in "0123456789,."]))
        self.classed, self.changes = self._steps(np.flatnonzero(letter | digit), lambda a, b: (letter[a] != letter[b]).astype(float))
        where = {ord(c): i for i, c in enumerate(KNOWN)}
        at = np.array([where.get(c, -1) for c in low.tolist()], dtype=np.int64)
        self.known, self.logs = self._steps(np.flatnonzero(at >= 0), lambda a, b: model.pairs[at[a], at[b]])
        _, kind = np.unique(low, return_inverse=True)
        self.of_kind = np.vstack([np.zeros((1, kind.max(initial=-1) + 1), dtype=np.int64), np.cumsum(np.eye(kind.max(initial=-1) + 1, dtype=np.int64)[kind], axis=0)])
        self.uuids = np.array([m.start() for m in _UUID.finditer(text)], dtype=np.int64)
        self.word_end = self._word_ends()

    @staticmethod
    def _sums(flags: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(flags))

    @staticmethod
    def _steps(places: np.ndarray, value) -> tuple[np.ndarray, np.ndarray]:
        """Places, and sums of a value of neighbouring ones."""
        return places, np.append(0.0, np.cumsum(value(places[:-1], places[1:]))) if len(places) else np.zeros(1)

    def _word_ends(self) -> np.ndarray:
        """For each start, the least end of a stretch that holds a run of letters which makes a word."""
        ends = np.full(self.n, self.n + 1)
        for a, b, least in SCRIPTS:
            inside = self._sums((self.code >= ord(a)) & (self.code <= ord(b)))
            full = np.flatnonzero(inside[least:] - inside[:-least] == least)
            k = np.searchsorted(full, np.arange(self.n))
            there = k < len(full)
            ends[there] = np.minimum(ends[there], full[k[there]] + least)
        return ends

    @staticmethod
    def _between(places: np.ndarray, sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of steps and sum of their values inside each stretch."""
        a, b = np.searchsorted(places, s), np.searchsorted(places, e)
        steps = np.maximum(b - a - 1, 0)
        top = len(sums) - 1
        return steps, np.where(steps > 0, sums[np.clip(b - 1, 0, top)] - sums[np.clip(a, 0, top)], 0.0)

    def masked(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which stretches are coordinates, numbers or identifiers."""
        n = e - s
        lo, hi = s + (self.code[s] == ord("@")), e - (self.code[e - 1] == ord("z"))
        place = (hi > lo) & (self.odd[np.maximum(hi, lo)] - self.odd[lo] == 0)
        size = (self.digits[e] - self.digits[s] == n - 1) & (self.crosses[e - 1] - self.crosses[s + 1] == 1)
        steps, logs = self._between(self.known, self.logs, s, e)
        letters = self.letters[e] - self.letters[s]
        counts = self.of_kind[e] - self.of_kind[s]
        spread = counts * np.log2(np.maximum(counts, 1))
        features = (
            np.exp(logs / np.maximum(steps, 1)),
            np.log2(n) - spread.sum(axis=1) / n,
            (self.hex[e] - self.hex[s]) / n,
            (self.vowels[e] - self.vowels[s]) / np.maximum(letters, 1),
            self._between(self.classed, self.changes, s, e)[1] / np.maximum(n - 1, 1),
        )
        score = self.model.bias + sum(w * x for w, x in zip(self.model.weights, features, strict=True))
        uuid = (n == 36) & np.isin(s, self.uuids)
        return (n >= SHORTEST) & (place | (e < self.word_end[s]) & (uuid | ~size & (score > self.model.limit)))

    def spans(self, start: int) -> list[tuple[int, int]]:
        """The longest stretch behind `start` that is to go, the rightmost of equal ones, then those beside it likewise."""
        s, e = np.triu_indices(self.n - start + 1, SHORTEST)
        s, e = s + start, e + start
        hit = self.masked(s, e)
        s, e = s[hit], e[hit]
        order = np.lexsort((-s, s - e))
        s, e = s[order], e[order]
        out = []
        while len(s):
            out.append((int(s[0]), int(e[0])))
            beside = (e <= s[0]) | (s >= e[0])
            s, e = s[beside], e[beside]
        return sorted(out)


def _is_masked(text: str, model: IdentifierModel) -> bool:
    return len(text) >= SHORTEST and bool(Stretches(text, model).masked(np.array([0]), np.array([len(text)]))[0])


def _prefix_spans(prefix: str, model: IdentifierModel) -> list[tuple[int, int]]:
    """Of the words in front, each by itself and each with all behind it, what is to go."""
    behind, spans, end = "", [], len(prefix)
    for word in reversed(prefix.split("-")[:-1]):
        if _is_masked(behind, model):
            behind, spans = MARK, [(end, len(prefix))]
        start = end - len(word) - 1
        if _is_masked(word, model):
            spans, word = [(start, end - 1), *spans], MARK
        behind, end = f"{word}-{behind}", start
    return spans


def _merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Masks that touch are one; a short rest behind the last goes, and from the end on short gaps go."""
    joined: list[list[int]] = []
    for s, e in spans:
        if joined and joined[-1][1] == s:
            joined[-1][1] = e
        else:
            joined.append([s, e])
    if joined and n - joined[-1][1] <= TAIL:
        joined[-1][1] = n
    while len(joined) > 1 and joined[-1][0] - joined[-2][1] <= GAP:
        joined.pop()
        joined[-1][1] = n
    return [(s, e) for s, e in joined]


def mask_spans(text: str, prefix: int, model: IdentifierModel) -> list[tuple[int, int]]:
    """Half-open spans of a text that are to go; its first `prefix` characters are words that are judged by themselves."""
    if _is_masked(text, model):
        return [(0, len(text))]
    rest = Stretches(text, model).spans(prefix) if len(text) - prefix >= SHORTEST else []
    return _merged([*_prefix_spans(text[:prefix], model), *rest], len(text))


def _spans_of(model: IdentifierModel):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in mask_spans(t, p, model)] for t, p in zip(texts, prefixes, strict=True)])

    return run


def _written(units: Column, spans: Column) -> Column:
    """The characters outside the spans as they were written, with a mark for each span."""
    piece = lambda a, b: F.array_join(F.slice(units, a + 1, b - a), "")
    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["text"], piece(acc["at"], x["start"]), F.lit(MARK)).alias("text"), x["end"].alias("at"))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["text"], piece(acc["at"], F.size(units))))


def mask_distinct(texts: DataFrame, column: str, model: IdentifierModel, out: str) -> DataFrame:
    """`texts` with `out`: the text, or null if that is null."""
    c = F.col(column)
    encoded = F.regexp_extract_all(c, F.lit(_UNIT), F.lit(0))
    decoded = F.when(F.contains(c, F.lit("%")) & (F.array_join(encoded, "") == c), decode_component(c))
    usable = F.coalesce((F.length(decoded) == F.size(encoded)) & ~F.contains(decoded, F.lit(MARK)), F.lit(False))
    t = texts.withColumn("_t", F.when(usable, decoded).otherwise(c)).withColumn("_units", F.when(usable, encoded).otherwise(F.split(c, "")))
    t = t.withColumn("_body", F.when(F.length("_t") >= MOST, F.substring("_t", 1, MOST - len(MARK))).otherwise(F.col("_t")))
    search = (F.length("_body") >= SEARCH) & F.coalesce(_plus_inside(F.col("_body")), F.lit(False))
    t = t.withColumn("_prefix", F.length(F.regexp_extract("_body", _PREFIX, 0))).withColumn("_search", search)
    t = t.withColumn("_spans", _spans_of(model)(F.coalesce("_body", F.lit("")), F.coalesce("_prefix", F.lit(0))))
    span = lambda s, e: F.array(F.struct(s.cast("int").alias("start"), e.cast("int").alias("end")))
    size, body = F.size("_units"), F.length("_body")
    ends = F.coalesce(F.get("_spans", F.size("_spans") - 1)["end"] == body, F.lit(False))
    cut = F.when(ends, F.concat(F.slice("_spans", F.lit(1), F.size("_spans") - 1), span(F.get("_spans", F.size("_spans") - 1)["start"], size))).otherwise(F.concat("_spans", span(body, size)))
    spans = F.when(F.col("_search"), span(F.lit(0), size)).when(F.length("_t") >= MOST, cut).otherwise(F.col("_spans"))
    masked = F.when(F.contains(c, F.lit(MARK)), F.lit(MARK)).when(c.isNotNull(), _written(F.col("_units"), spans))
    return t.withColumn(out, masked).drop("_t", "_units", "_body", "_prefix", "_search", "_spans")


def _plus_inside(c: Column) -> Column:
    """A plus with other characters on both sides."""
    return let(F.regexp_replace(c, r"^\++|\++$", ""), lambda x: F.contains(x, F.lit("+")))


def mask_column(df: DataFrame, column: str, model: IdentifierModel, out: str = "masked") -> DataFrame:
    """`df` with `out`: each distinct text is masked once and joined back. Null stays null, an empty text empty."""
    distinct = df.select(F.col(column).alias("_text")).where(F.col(column).isNotNull()).distinct()
    masked = mask_distinct(distinct, "_text", model, out)
    return df.join(masked, F.col(column) == F.col("_text"), "left").drop("_text")


def mask_hosts(df: DataFrame, column: str, model: IdentifierModel, out: str = "masked", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """`df` with `out`: hosts that are a registrable domain stay, others have each label masked."""
    c = F.col(column)
    hosts = df.select(c.alias("_host")).where(c.isNotNull() & ~F.coalesce(registrable_domain(c, suffixes) == c, F.lit(False))).distinct()
    labels = mask_column(hosts.select("_host", F.posexplode(F.split("_host", r"\.")).alias("_at", "_label")), "_label", model, "_masked")
    whole = labels.groupBy("_host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_masked"))), lambda x: x["_masked"]), ".").alias(out))
    return df.join(whole, c == F.col("_host"), "left").withColumn(out, F.coalesce(out, c)).drop("_host")
