"""Substring dedup: a count-min prefilter, then exact grouping of the windows that may repeat.

A window is `window` consecutive words. Its sketch key is the smallest hash of
the grams of half its length inside it: a function of its words alone, so
equal windows have equal keys, while neighbouring windows mostly share one
and a document has few distinct keys. Each partition counts the keys of its
documents in a sketch of two lanes; the merged counts are never below the
number of documents that hold a window, so a window whose key counts less
than two in either lane repeats nowhere else. The second pass computes
128-bit digests of the other windows only and groups them exactly. The
sketch has four cells a key in each lane, is kept as rows and grows with the
input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import log2_ceil, row_key, small_batches, small_side, texts_of, worker_held
from webtel.session import Stages

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it holds too many."""

    def __init__(self, seed: int, most: int = 150_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of all runs of k words: a polynomial modulo 2**64, then mixed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)]))

        self.up, self.down = powers(self.base), powers(self.inverse)

    def of(self, w: np.ndarray, k: int) -> np.ndarray:
        n = len(w)
        if n >= len(self.up):
            self._grow(2 * n)
        c = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w * self.up[:n], out=c[1:])
        x = (c[k:] - c[:-k]) * self.down[: n - k + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values, by doubling."""
    width, m = 1, x
    while 2 * width <= k:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(x) - k + 1], m[k - width : k - width + len(x) - k + 1])


class _Hasher:
    """One per Python worker: word hashes stay between tasks."""

    def __init__(self):
        self.words = [WordHashes(1), WordHashes(2)]
        self.rolls = [Rolling(b) for b in _BASES]

    @classmethod
    def get(cls) -> _Hasher:
        return worker_held((cls,), cls)

    def keys(self, w: np.ndarray, window: int) -> np.ndarray:
        """The sketch key of each window."""
        gram = max(1, window // 2)
        return _sliding_min(self.rolls[0].of(w, gram), window - gram + 1)


def _document_keys(window: int):
    def run(batches):
        h = _Hasher.get()
        for b in batches:
            ids, rids, s1, s2, keys = [], [], [], [], []
            for i, r, t in zip(b.column("id").to_pylist(), b.column("rid").to_pylist(), texts_of(b, "t"), strict=True):
                words = t.split()
                if len(words) < window:
                    continue
                w = h.words[0].of(words)
                whole = xxhash.xxh3_128_digest(b" ".join(words))
                a, c = np.frombuffer(whole, dtype="<i8")
                ids.append(i)
                rids.append(r)
                s1.append(int(a))
                s2.append(int(c))
                keys.append(np.unique(h.keys(w, window)).view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "rid", "seq1", "seq2", "keys"],
            )

    return run


def _partition_sketch(bits: int):
    """The non-zero cells of a partition's count-min sketch; counts above two stay two."""

    def flush(held):
        key = np.concatenate(held).view(np.uint64)
        for lane, cell in enumerate((key & np.uint64((1 << bits) - 1), key >> np.uint64(64 - bits))):
            u, n = np.unique(cell, return_counts=True)
            for i in range(0, len(u), 1 << 16):
                part = u[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), lane, np.int32)), pa.array(part), pa.array(np.minimum(n[i : i + (1 << 16)], 2).astype(np.int32))],
                    ["lane", "cell", "hits"],
                )

    def run(batches):
        held, n = [], 0
        for b in batches:
            col = b.column("keys")
            held.append(col.flatten().to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= 1 << 21:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _window_digests(window: int):
    def run(batches):
        h = _Hasher.get()
        for b in batches:
            for i, r, t, flat in zip(b.column("id").to_pylist(), b.column("rid").to_pylist(), texts_of(b, "t"), b.column("flagged"), strict=True):
                words = t.split()
                w = [x.of(words) for x in h.words]
                at = np.flatnonzero(np.isin(h.keys(w[0], window).view(np.int64), np.asarray(flat.values)))
                if not len(at):
                    continue
                d = [roll.of(x, window)[at].view(np.int64) for roll, x in zip(h.rolls, w, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[0]), pa.array(d[1]), pa.array(np.full(len(at), i, np.int64)), pa.array(np.full(len(at), r, np.int64)), pa.array(at.astype(np.int32))],
                    ["h1", "h2", "id", "rid", "start"],
                )

    return run


def _cover(window: int):
    """Window starts of a document to the word ranges that they cover, as b0, e0, b1, e1, ..."""

    def run(batches):
        for b in batches:
            out = []
            for s in b.column("starts"):
                s = np.unique(np.asarray(s.values))
                new = np.flatnonzero(np.diff(s) > window) + 1
                begin, end = s[np.append(0, new)], s[np.append(new - 1, len(s) - 1)] + window
                out.append(np.column_stack([begin, end]).ravel().astype(np.int32))
            offsets = np.cumsum([0, *map(len, out)], dtype=np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "rid", "cover"])

    return run


def repeated_ranges(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, cover): word ranges to remove, for documents that have any; rid is row_key(id, text).

    Copies of a document are settled as a whole first: only the one with the
    smallest id takes part in the window passes, the others are covered from
    their first to their last word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stages = Stages(spark, "substring")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    base = base.where("id is not null").withColumn("rid", row_key("id", "t"))

    seen = stages.write(base.mapInArrow(_document_keys(window), "id long, rid long, seq1 long, seq2 long, keys array<long>"), "keys")
    classes = seen.groupBy("seq1", "seq2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    classes = stages.write(classes, "classes")
    with_first = seen.join(classes, ["seq1", "seq2"], "left")
    single = with_first.where("first is null or id = first").select("id", "rid", "keys")
    copies = with_first.where("id > first").select("id", "rid", F.array(F.lit(0), F.lit(2**31 - 1)).alias("cover"))

    n_keys = seen.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(60, max(16, log2_ceil(n_keys) + 2))
    sketch = single.select("keys").mapInArrow(_partition_sketch(bits), "lane int, cell long, hits int")
    merged = sketch.groupBy("lane", "cell").agg(F.sum("hits").alias("hits")).where("hits >= 2")
    merged = stages.write(merged, "sketch")

    exploded = single.select("id", "rid", F.explode("keys").alias("key"))
    exploded = exploded.withColumn("cell", F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    exploded = exploded.join(merged.where("lane = 0").select("cell"), "cell", "left_semi").drop("cell")
    exploded = exploded.withColumn("cell", F.shiftrightunsigned("key", 64 - bits))
    exploded = exploded.join(merged.where("lane = 1").select("cell"), "cell", "left_semi")
    flagged = stages.write(exploded.groupBy("id", "rid").agg(F.collect_list("key").alias("flagged")), "flagged")

    windows = base.join(small_side(flagged, 64, "flagged"), ["id", "rid"]).select("id", "rid", "t", "flagged")
    windows = stages.write(windows.mapInArrow(_window_digests(window), "h1 long, h2 long, id long, rid long, start int"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    first = stages.write(first.select("h1", "h2", "first"), "first")
    hit = windows.join(first, ["h1", "h2"]).where("id > first")
    starts = hit.groupBy("id", "rid").agg(F.collect_list("start").alias("starts"))
    parts = starts.mapInArrow(_cover(window), "id long, rid long, cover array<int>")
    cover = stages.write(parts.unionByName(copies).dropDuplicates(["id", "rid"]), "cover")
    stages.keep_only("cover")
    return cover


def _apply(batches, texts: bool):
    for b in batches:
        n_words, n_removed, out = [], [], []
        for t, cover in zip(texts_of(b, "t"), b.column("cover"), strict=True):
            words = t.split()
            kept = words
            if cover.is_valid:
                keep = np.ones(len(words), dtype=bool)
                c = np.asarray(cover.values)
                for s, e in zip(c[::2], c[1::2], strict=True):
                    keep[s:e] = False
                kept = [words[i] for i in np.flatnonzero(keep)]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            out.append(b" ".join(kept) if texts else hashlib.sha256(b" ".join(kept)).hexdigest())
        cols = [b.column("id")] if not texts else [b.column(i) for i in range(b.num_columns) if b.schema.names[i] not in ("t", "cover")]
        names = ["id"] if not texts else [x for x in b.schema.names if x not in ("t", "cover")]
        last = pa.array([x.decode() for x in out], pa.string()) if texts else pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], [*names, "n_words", "n_removed", "out"])


def digest_without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_words, n_removed, out); out is the SHA-256 of the kept words joined by spaces.

    A word goes if a window over it also starts in a document with a smaller
    id. Null and empty texts have no words; texts of any length are read as
    a whole, one at a time. A row with a null id removes nothing and keeps
    all. Rows that share an id, repeated rows among them, never remove from
    each other. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    cover = small_side(repeated_ranges(docs, window, id_col, text_col), 64, "cover")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("rid", row_key("id", "t"))
    d = d.join(cover, ["id", "rid"], "left").select("id", "t", "cover")
    return d.mapInArrow(lambda it: _apply(it, False), "id long, n_words long, n_removed long, out string")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated words cut from the texts; a text that loses words has the others joined by one space.

    Which words go, and the odd cases, are as in digest_without_repeats; all
    other columns and texts, nulls among them, stay as they are.
    """
    cover = small_side(repeated_ranges(docs, window, id_col, text_col), 64, "cover")
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    d = docs.select(*own, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("rid", row_key("id", "t"))
    j = d.join(cover, ["id", "rid"], "left").drop("id", "rid")
    schema = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out = j.mapInArrow(lambda it: _apply(it, True), f"{schema}, n_words long, n_removed long, out string")
    k = docs.columns.index(text_col)
    text = F.when(F.col("n_removed") > 0, F.col("out")).otherwise(F.col(f"_c{k}"))
    return out.select(*[(text if i == k else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])
