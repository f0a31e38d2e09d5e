"""Rotating Bloom filters: bitmaps by generation, with one hash and several sizes that have no common divisor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.functions.numbers import pairwise_coprime

WORD = 32


def _hash(value: Column) -> Column:
    """52 bits of a value."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 13), 16, 10).cast("long")


def _bits(value: Column, sizes: list[int]) -> Column:
    """Place of a value in each part, as (part, word, bit)."""
    h = _hash(value)
    place = lambda i, m: F.struct(F.lit(i).alias("part"), F.floor(F.pmod(h, F.lit(m)) / WORD).alias("word"), F.pmod(F.pmod(h, F.lit(m)), F.lit(WORD)).cast("int").alias("bit"))
    return F.array(*[place(i, m) for i, m in enumerate(sizes)])


def generation(at: Column, every: int) -> Column:
    """The beginning of the generation that a time belongs to: intervals of `every` since the epoch."""
    return F.floor(at / every) * every


def added(values: DataFrame, value: str, generation: str, sizes: list[int]) -> DataFrame:
    """(generation, part, word, bits): the filter of each generation as rows that are or-ed together. Null values are not added."""
    if not sizes or min(sizes) <= 0 or not pairwise_coprime(sizes):
        raise ValueError("sizes must be positive and have no common divisor")
    rows = values.where(F.col(value).isNotNull() & F.col(generation).isNotNull()).select(F.col(generation).alias("generation"), F.explode(_bits(F.col(value), sizes)).alias("b"))
    one = F.expr("shiftleft(1L, b.bit)")
    return rows.groupBy("generation", "b.part", "b.word").agg(F.bit_or(one).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """Union of filters of the same sizes, generation by generation."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("generation", "part", "word").agg(F.bit_or("bits").alias("bits"))


def rotated(filters: DataFrame, now: Column, every: int, most: int = 2) -> DataFrame:
    """The rows of generations that are still held at `now`.

    Generations are numbers of the same unit as `now`, their beginnings.
    Those more than two intervals ahead (a clock that jumped) or older than
    `most` intervals go, and of the others all but the newest `most`.
    """
    in_range = (F.col("generation") <= now + 2 * every) & (F.col("generation") >= now - every * most)
    held = filters.where(in_range)
    newest = held.select("generation").distinct().orderBy(F.desc("generation")).limit(most)
    return held.join(newest, "generation", "left_semi")


def might_contain(df: DataFrame, value: str, filters: DataFrame, sizes: list[int]) -> DataFrame:
    """`df` with `might_contain`: whether all places of a value are set in one of the generations; false for null.

    Distinct values are joined with the words that they need, so that
    filters of any size are never sent to one place.
    """
    probes = df.select(F.col(value).alias("_value")).where(F.col(value).isNotNull()).distinct()
    probes = probes.select("_value", F.explode(_bits(F.col("_value"), sizes)).alias("b")).select("_value", "b.*")
    hit = probes.join(filters, ["part", "word"]).where(F.expr("shiftright(bits, bit) & 1 = 1"))
    full = hit.groupBy("_value", "generation").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(sizes))
    held = full.select("_value").distinct().withColumn("_held", F.lit(True))
    return df.join(held, F.col(value) == F.col("_value"), "left").withColumn("might_contain", F.coalesce("_held", F.lit(False))).drop("_value", "_held")
