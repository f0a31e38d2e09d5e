"""Message padding and Bloom filters."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BYTES, MOST_BYTES = 1024, 32767


@F.pandas_udf(T.BinaryType())
def compress_and_pad(payload: pd.Series) -> pd.Series:
    """Deflated text behind its length (4 bytes), padded with zeros to a power of two of at least 1 KiB; null if too long."""

    def one(text):
        if text is None or len(text.encode()) >= MOST_BYTES:
            return None
        packed = zlib.compress(text.encode())
        size = max(LEAST_BYTES, 1 << (len(packed) + 3).bit_length())
        return (len(packed).to_bytes(4, "big") + packed).ljust(size, b"\0")

    return payload.map(one)


def unpad(data: bytes) -> str:
    n = int.from_bytes(data[:4], "big")
    return zlib.decompress(data[4 : 4 + n]).decode()


def bloom_bits(value: Column, k: int, m: int) -> Column:
    """The k bit positions of a value, by double hashing with two words of its MD5."""
    word = lambda i: F.conv(F.substring(F.md5(value), i, 8), 16, 10).cast("long")
    a, b = word(1), word(9)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(a + i.cast("long") * b, F.lit(m)))


def bloom_table(df: DataFrame, value: str, k: int, m: int, words: int = 32) -> DataFrame:
    """A Bloom filter as rows (word, bits): it is built and merged by one aggregate and can grow with m."""
    bit = df.select(F.explode(bloom_bits(F.col(value), k, m)).alias("bit")).distinct()
    one = F.expr(f"shiftleft(1L, cast(pmod(bit, {words}) as int))")
    return bit.groupBy(F.floor(F.col("bit") / words).alias("word")).agg(F.bit_or(one).alias("bits"))


def merge_blooms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bloom_contains(df: DataFrame, value: str, bloom: DataFrame, k: int, m: int, words: int = 32) -> DataFrame:
    """`df` with `might_contain`; values are probed once each, by a join on the words they need."""
    probes = df.select(value).distinct().withColumn("bit", F.explode(F.array_distinct(bloom_bits(F.col(value), k, m))))
    probes = probes.withColumn("word", F.floor(F.col("bit") / words)).join(bloom, "word", "left")
    hit = F.coalesce(F.expr(f"(bits >>> cast(pmod(bit, {words}) as int)) & 1 = 1"), F.lit(False))
    verdict = probes.withColumn("hit", hit).groupBy(value).agg(F.bool_and("hit").alias("might_contain"))
    return df.join(verdict, value, "left")


def read_packed_bloom(data: bytes) -> tuple[int, np.ndarray]:
    """(k, words) of a packed filter: number of words and k, then the words, all big endian."""
    n = int.from_bytes(data[:4], "big")
    return data[4], np.frombuffer(data, dtype=">u4", count=n, offset=5)
