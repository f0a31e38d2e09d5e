"""Messages and nested values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truncated_hash(c: Column) -> Column:
    """The first 16 hex digits of the MD5."""
    return F.substring(F.md5(c), 1, 16)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def message(action: str, payload: dict[str, Column], channel: str, ts: Column, dedup: list[str] | None = None) -> Column:
    """(action, payload_json, dedup_key): what a sink takes. The key covers the action and the named payload fields."""
    body = F.to_json(F.struct(F.lit(action).alias("action"), F.lit(channel).alias("channel"), F.struct(*[payload[k].alias(k) for k in sorted(payload)]).alias("payload"), ts.alias("ts")))
    named = payload if dedup is None else {k: payload[k] for k in dedup}
    key = F.sha1(F.concat(F.lit(action + "\n"), F.coalesce(canonical_json(named), F.lit(""))))
    return F.struct(F.lit(action).alias("action"), body.alias("payload_json"), key.alias("dedup_key"))


def json_text(c: Column, path: str, most: int = 1 << 20) -> Column:
    """A scalar of a JSON text by a dotted path, as text; empty if missing, no scalar, or the text is too long."""
    found = F.get_json_object(c, "$." + path)
    return F.when((F.length(c) <= most) & ~found.rlike(r"^[\[{]"), found).otherwise("")


def headers(c: Column) -> Column:
    """Lower-cased header names to values, the last of equal names wins."""
    names = F.transform(c, lambda h: F.lower(h["name"]))
    last = lambda n: F.element_at(F.filter(c, lambda h: F.lower(h["name"]) == n), -1)["value"]
    distinct = F.array_distinct(names)
    return F.map_from_arrays(distinct, F.transform(distinct, last))


def zip_records(columns: dict[str, Column], required: list[str]) -> Column:
    """Parallel arrays as an array of records; records that lack a required value go."""
    records = F.arrays_zip(*[c.alias(k) for k, c in columns.items()])
    ok = lambda r: F.array_contains(F.array(*[F.coalesce(F.length(r[k].cast("string")) > 0, F.lit(False)) for k in required]), False) == False  # noqa: E712, E731
    return F.filter(records, ok) if required else records


def first_wins(records: Column) -> Column:
    """An array of string maps merged: each key keeps its first value, unless a later one differs, which drops it."""
    pairs = F.flatten(F.transform(records, F.map_entries))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]))
    same = F.filter(keys, lambda k: F.size(values(k)) == 1)
    return F.map_from_arrays(same, F.transform(same, lambda k: F.element_at(values(k), 1)))


def chunks(c: Column, size: int) -> Column:
    starts = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(c, s, size))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def flatten_json(texts: pd.Series) -> pd.Series:
    """All scalar leaves of a JSON text as (dotted path, value)."""
    import json

    def leaves(value, path):
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if items is None:
            yield {"path": path, "value": None if value is None else value if isinstance(value, str) else json.dumps(value)}
        else:
            for k, v in items:
                yield from leaves(v, f"{path}.{k}" if path else str(k))

    def one(t):
        try:
            return list(leaves(json.loads(t), ""))
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def without_nulls(c: Column) -> Column:
    """JSON of a struct without its null fields, at any depth."""
    return F.to_json(c, {"ignoreNullFields": "true"})


def provably_equal(a: Column, b: Column) -> Column:
    """Deep equality of scalars, arrays and structs of one type; nulls equal each other."""
    return a.eqNullSafe(b)


def at_path(c: Column, kind: T.DataType, path: str) -> Column:
    """Values at a path such as a, b.0.c or b.[].c in a nested column of a type; null if there are none.

    A number picks one item of an array, [] all items of an array or values
    of a map that have the rest of the path.
    """

    def go(c: Column, kind: T.DataType, steps: list[str]) -> tuple[Column, T.DataType] | None:
        if not steps:
            return c, kind
        head, rest = steps[0], steps[1:]
        if isinstance(kind, T.StructType):
            return go(c[head], kind[head].dataType, rest) if head in kind.names else None
        if isinstance(kind, T.MapType) and head != "[]":
            return go(F.try_element_at(c, F.lit(head).cast(kind.keyType)), kind.valueType, rest)
        if isinstance(kind, T.ArrayType) and head.isdigit():
            return go(F.get(c, F.lit(int(head))), kind.elementType, rest)
        if head != "[]" or not isinstance(kind, (T.ArrayType, T.MapType)):
            return None
        of = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        inner = go(F.lit(None).cast(of), of, rest)
        if inner is None:
            return None
        if isinstance(kind, T.ArrayType):
            found = F.filter(F.transform(c, lambda x: go(x, of, rest)[0]), lambda x: x.isNotNull())
            return F.when(F.size(found) > 0, found), T.ArrayType(inner[1])
        found = F.map_filter(F.transform_values(c, lambda _, x: go(x, of, rest)[0]), lambda _, x: x.isNotNull())
        return F.when(F.size(found) > 0, found), T.MapType(kind.keyType, inner[1])

    found = go(c, kind, path.split("."))
    return F.lit(None) if found is None else found[0]


def dedup_key(action: Column, payload: Column, kind: T.DataType, paths: str = "") -> Column:
    """SHA-1 of the action and the values at comma-separated paths of a payload, or all of it; absent ones are null."""
    values = [at_path(payload, kind, p) for p in paths.split(",")] if paths else [payload]
    texts = F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "true"})
    return F.sha1(F.concat_ws("\n", action, texts))
