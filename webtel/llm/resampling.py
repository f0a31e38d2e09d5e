"""Importance resampling towards a target's distribution of hashed n-grams.

Words of a run of documents become ids in one flat array, with a 0 after each
document. Its suffix array is sorted as deep as the longest n-gram (prefix
doubling), and LCPs of neighbours give, for each length, the runs of suffixes
that begin with the same n-gram: the n-gram is written and hashed once a run,
and the bucket is scattered back to the run's places. A partition is worked
off in runs of about CHUNK words, so memory does not grow with it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import small_batches, texts_of
from webtel.operators.numbering import running_total
from webtel.session import Stages

#: Words of one suffix array, if no document has more.
CHUNK = 1 << 20
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 22

#: Bytes as they count: A-Z as a-z, digits, a-z and bytes of other characters as they are, the rest as a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Ids(dict):
    """Numbers of words from 1 in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = len(self) + 1
        return v

    def of(self, text: bytes) -> Iterator[np.ndarray]:
        clean, start = text.translate(_BYTES), 0
        while start < len(clean):
            end = clean.find(b" ", start + SLICE)
            end = len(clean) if end < 0 else end
            words = clean[start:end].split()
            yield np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
            start = end


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` words that begin there; ties in the order of places."""
    order, width = np.argsort(ids, kind="stable"), 1
    rank = ids.astype(np.int64)
    while width < depth:
        sorted_rank = rank[order]
        dense = np.empty(len(ids), dtype=np.int64)
        dense[order] = np.cumsum(np.append(1, sorted_rank[1:] != sorted_rank[:-1]))
        beyond = np.append(dense[width:], np.zeros(min(width, len(ids)), dtype=np.int64))
        rank = dense * (len(ids) + 1) + beyond
        order = np.argsort(rank, kind="stable")
        width *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix shares with the one before it, `depth` at most; a 0 ends a document and is shared with none."""
    lcp = np.zeros(len(order), dtype=np.int32)
    going = np.ones(max(0, len(order) - 1), dtype=bool)
    padded = np.append(ids, np.zeros(depth, dtype=ids.dtype))
    for j in range(depth):
        a, b = padded[order[1:] + j], padded[order[:-1] + j]
        going &= (a == b) & (a != 0)
        lcp[1:] += going
    return lcp


def occurrences(ids: np.ndarray, words: list[bytes], low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the places where an n-gram begins and its bucket: CRC-32 of its words joined by spaces."""
    order = suffix_array(ids, high)
    lcp = common_prefixes(ids, order, high)
    padded = np.append(ids, np.zeros(high, dtype=ids.dtype))
    full = np.ones(len(order), dtype=bool)
    for n in range(1, high + 1):
        full &= padded[order + n - 1] != 0
        if n < low:
            continue
        at = order[full]
        first = lcp[full] < n
        grams = padded[at[first][:, None] + np.arange(n)[None, :]] if n > 1 else ids[at[first]][:, None]
        hashed = np.fromiter((zlib.crc32(b" ".join([words[i - 1] for i in g])) for g in grams.tolist()), dtype=np.int64, count=len(grams)) % buckets
        yield at, hashed[np.cumsum(first) - 1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[bytes]]]:
    """Batches' ids, words of each document, the flat array of word ids and the words, for about CHUNK words at a time."""
    names, lengths, flat, vocabulary, n = [], [], [], Ids(), 0
    end = np.zeros(1, dtype=np.int32)
    for b in batches:
        for i, t in zip(b.column("id").to_pylist(), texts_of(b, "t"), strict=True):
            parts = list(vocabulary.of(t))
            names.append(i)
            lengths.append(sum(map(len, parts)))
            flat += [*parts, end]
            n += lengths[-1] + 1
            if n >= CHUNK:
                yield names, np.array(lengths), np.concatenate(flat), list(vocabulary)
                names, lengths, flat, vocabulary, n = [], [], [], Ids(), 0
    if names:
        yield names, np.array(lengths), np.concatenate(flat), list(vocabulary)


def _counted(low: int, high: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, _, ids, words in _chunks(batches):
            for _, bucket in occurrences(ids, words, low, high, buckets):
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return run


def _weighed(low: int, high: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lengths, ids, words in _chunks(batches):
            gain, n = np.zeros(len(ids) + 1, dtype=np.int64), np.zeros(len(ids) + 1, dtype=np.int64)
            for at, bucket in occurrences(ids, words, low, high, len(gains)):
                gain[at + 1] += gains[bucket]
                n[at + 1] += 1
            ends = np.cumsum(lengths + 1)
            gain, n = np.cumsum(gain)[ends], np.cumsum(n)[ends]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(lengths), pa.array(np.diff(n, prepend=0)), pa.array(np.diff(gain, prepend=0))], ["id", "n_words", "n_features", "weight"]
            )

    return run


def bucket_counts(docs: DataFrame, low: int, high: int, buckets: int, text_col: str = "text") -> dict[int, int]:
    """Features of all texts by bucket; at most `buckets` entries reach the driver."""
    d = docs.select(F.lit(None).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = d.mapInArrow(_counted(low, high, buckets), "bucket long, n long")
    return {r.bucket: r.n for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log-likelihood ratio of each bucket, add-one smoothed, rounded down."""
    s_all, t_all = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratio = ((float(target.get(b, 0) + 1) * float(s_all)) / (float(raw.get(b, 0) + 1) * float(t_all)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(i: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on the seed and the id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(i.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_features, weight, score, rank); rank is null for those that are not drawn.

    Features are all runs of `low` to `high` words. Drawn are the highest
    scores, weight plus noise, among documents with `least_words` words:
    `percent` of a hundred of them, rounded down, ties to the smaller id.
    Null and empty texts have no feature, weight 0, and a score that is the
    noise. Texts of any length count whole. Repeated rows count and are
    drawn each by itself; rows with equal ids get the same noise, a null id
    that of an empty one, and come after others of the same score. An empty
    target is the uniform distribution; an empty table gives an empty
    result. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stages = Stages(spark, "resample")
    gain = gains(bucket_counts(docs, low, high, buckets, text_col), bucket_counts(target, low, high, buckets, target_col), buckets)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    weighed = d.mapInArrow(_weighed(low, high, gain), "id long, n_words long, n_features long, weight long")
    scored = stages.write(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    enough = F.col("n_words") >= least_words
    most = scored.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight")]
    ranked = running_total(scored.where(enough), [], order, 1, "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")
