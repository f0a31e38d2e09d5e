"""Line dedup: lines that stand in many documents, found by a range-partitioned sort, returned as bitmaps.

A row for each line, of the 128-bit hash of its key, its document and its
position, is range-partitioned and sorted by all of them, so that even a line
of a third of all rows is cut over many tasks. Each task streams its rows:
lines of one key are a run, in the order of documents and positions. Runs
inside a task are settled there; of its first and last run, which may go on
in the neighbouring tasks, it reports a marker or less than `least_docs`
documents' rows, and these few are settled by a join. What comes back for a
document is a compressed bitmap of the lines that stay, not text.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.llm.common import group_starts, row_key, small_batches, texts_of, without
from webtel.session import Stages

#: What is stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: Rows of hashed lines that are handed on at once.
HASHED_ROWS = 50_000
#: Texts of one vector that is read, and the most bitmaps of a partition that are hashed rather than sorted.
READ_ROWS, HASH_SIDE = 256, "64m"
#: Rows of the streaming step: surely dropped, undecided, and first of a decided run at a task's edge.
DROPPED, OPEN, MARKER = 0, 1, 2
_FOUND = "id long, rid long, pos int, h1 long, h2 long, state int"


def _small_buffers(spark: SparkSession) -> None:
    """Keep an executor's heap small where texts are long: buffers of many megabytes make the JVM's collector run often and grow its heap.

    Vectors of 4096 texts are such buffers, and so are the pages of a sort by
    which texts would meet bitmaps; Spark hashes the bitmaps instead where no
    partition has more than HASH_SIDE, and sorts, with spills, where one has.
    Spark reads these settings when a query runs, so they stay; tighter ones,
    and a threshold that a session has, are kept.
    """
    small_batches(spark)
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, str(min(READ_ROWS, int(spark.conf.get(rows)))))
    side = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(side, "0").rstrip("bB") == "0":
        spark.conf.set(side, HASH_SIDE)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, t): rid is a hash of id and text, so a row with a null id has its own."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return base.select(F.coalesce("_i", F.lit(0)).alias("id"), row_key("_i", "t").alias("rid"), "t")


def _hashed(least_chars: int):
    """Texts to a row for each line whose key has `least_chars` code points or more, and one at least.

    Texts are bytes here, since lowering bytes changes A-Z alone; Spark's
    `translate` makes an object for each character, most of the heap's garbage.
    """

    def handed_on(digests: list[bytes], places: list[tuple[int, int, int]]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        ids, rids, pos = zip(*places, strict=True)
        columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(pos, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id", "rid", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, places = [], []
        for b in batches:
            for i, r, t in zip(b.column("id").to_pylist(), b.column("rid").to_pylist(), texts_of(b, "t"), strict=True):
                for pos, line in enumerate(io.BytesIO(t)):
                    key = line.strip(BLANKS).lower()
                    if key and (least_chars <= 1 or len(key.decode(errors="replace")) >= least_chars):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        places.append((i, r, pos))
                        if len(digests) == HASHED_ROWS:
                            yield handed_on(digests, places)
                            digests, places = [], []
        if digests:
            yield handed_on(digests, places)

    return run


def _rows(columns: list[np.ndarray], state: int) -> pa.RecordBatch:
    h1, h2, i, r, pos = columns
    n = len(i)
    hashes = [pa.nulls(n, pa.int64())] * 2 if state == DROPPED else [pa.array(h1), pa.array(h2)]
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(r), pa.array(pos), *hashes, pa.array(np.full(n, state, np.int32))], ["id", "rid", "pos", "h1", "h2", "state"])


def _streamed(least: int, keep_first: bool):
    """Sorted rows to rows of lines that go, or may go.

    Of a run whose end has not come, the rows are held while it has fewer
    than `least` documents, and passed on at once from then on, except its
    first row: that one is a marker if the run touches an edge of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of an undecided run
        mark: list[np.ndarray] | None = None  # first row of a decided run
        edge = True  # the current run is the task's first

        def settled(first: list[np.ndarray], at_edge: bool):
            if at_edge:
                yield _rows(first, MARKER)
            elif not keep_first:
                yield _rows(first, DROPPED)

        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "id", "rid", "pos")]
            if mark is not None:
                other = (rows[0] != mark[0][0]) | (rows[1] != mark[1][0])
                m = int(other.argmax()) if other.any() else len(other)
                if m:
                    yield _rows([x[:m] for x in rows], DROPPED)
                if m == len(other):
                    continue
                rows = [x[m:] for x in rows]
                yield from settled(mark, edge)
                mark, edge = None, False
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                held = None
            if not len(rows[0]):
                continue
            starts = group_starts(rows[:2])
            new = np.zeros(len(rows[0]), dtype=np.int64)
            new[group_starts(rows[:4])[:-1]] = 1
            many = np.add.reduceat(new, starts[:-1]) >= least
            of_run = np.repeat(np.arange(len(many)), np.diff(starts))
            whole = many.copy()
            whole[-1] = False
            if edge and len(many) > 1:
                first = [x[: starts[1]] for x in rows]
                if many[0]:
                    yield _rows([x[:1] for x in first], MARKER)
                    yield _rows([x[1:] for x in first], DROPPED)
                else:
                    yield _rows(first, OPEN)
                whole[0] = False
            edge = edge and len(many) == 1
            goes = whole[of_run]
            if keep_first:
                goes[starts[:-1]] = False
            if goes.any():
                yield _rows([x[goes] for x in rows], DROPPED)
            last = [x[starts[-2] :] for x in rows]
            if many[-1]:
                mark = [x[:1] for x in last]
                if len(last[0]) > 1:
                    yield _rows([x[1:] for x in last], DROPPED)
            else:
                held = last
        if mark is not None:
            yield _rows(mark, MARKER)
        if held is not None:
            yield _rows(held, OPEN)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions that go, to a bitmap of the lines up to the last of them, in whole bytes: 1 stays, 0 goes."""
    for b in batches:
        maps, n = [], []
        for pos in b.column("gone"):
            at = np.asarray(pos.values)
            keep = np.ones(-(-(int(at.max()) + 1) // 8) * 8, dtype=np.uint8)
            keep[at] = 0
            n.append(len(keep) - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], ["id", "rid", "n_dropped", "keep"])


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A bitmap as booleans for all lines; those after its end stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)[:n_lines]
    return np.concatenate([bits, np.ones(n_lines - len(bits), dtype=bool)])


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, n_dropped, keep) of each document that loses lines; keep is read with kept_lines.

    A line goes if its key has `least_chars` code points or more and stands
    in `least_docs` documents or more; with `keep_first`, the occurrence of
    the smallest id and position stays. Rows with the same id and text,
    nulls among them, are one document; id is 0 where it is null, and rid
    tells such rows apart.
    """
    _small_buffers(docs.sparkSession)
    stages = Stages(docs.sparkSession, "lines")
    texts = _identified(docs, id_col, text_col).where("t is not null")
    hashed = texts.mapInArrow(_hashed(least_chars), "h1 long, h2 long, id long, rid long, pos int")
    order = ["h1", "h2", "id", "rid", "pos"]
    streamed = hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_streamed(least_docs, keep_first), _FOUND)
    found = stages.write(streamed, "found")

    at_edges = found.where(F.col("state") != DROPPED)
    counts = at_edges.groupBy("h1", "h2").agg(F.max("state").alias("most"), F.count_distinct("id", "rid").alias("docs"), F.min(F.struct("id", "rid", "pos")).alias("first"))
    common = counts.where((F.col("most") == MARKER) | (F.col("docs") >= least_docs)).select("h1", "h2", "first")
    late = at_edges.join(common, ["h1", "h2"])
    if keep_first:
        late = late.where(F.struct("id", "rid", "pos") != F.col("first"))
    gone = found.where(F.col("state") == DROPPED).select("id", "rid", "pos").unionByName(late.select("id", "rid", "pos"))
    gone = gone.groupBy("id", "rid").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(_bitmaps, "id long, rid long, n_dropped long, keep binary")


def _applied(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for t, keep in zip(texts_of(b, "t"), b.column("keep").to_pylist(), strict=True):
                n.append(t.count(b"\n") + 1)
                if keep is not None:
                    lines = t.split(b"\n")
                    t = b"\n".join([lines[i] for i in np.flatnonzero(kept_lines(keep, len(lines)))])
                out.append(t.decode() if texts else hashlib.sha256(t).hexdigest())
            rest = [c for c in b.schema.names if c not in ("t", "keep")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(n, pa.int64()), pa.array(out, pa.string())], [*rest, "_lines", "_out"])

    return run


def _joined(docs: DataFrame, maps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with their columns as _c0, _c1, ..., the text as t, n_dropped and keep."""
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    d = docs.select(*own, F.col(f"`{id_col}`").cast("long").alias("_i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    d = d.withColumn("rid", row_key("_i", "t")).withColumn("id", F.coalesce("_i", F.lit(0))).drop("_i")
    return d.join(maps, ["id", "rid"], "left").drop("id", "rid")


def digest_without_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_lines, n_dropped, out); out is the SHA-256 of the lines that stay, joined by \\n.

    A null or empty text is one empty line, which stays. Texts of any length
    are read whole. Rows with the same id and text are one document and have
    equal results; a null id stays null. An empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("x"))
    j = _joined(own, keep_bitmaps(docs, least_docs, least_chars, False, id_col, text_col), "i", "x").drop("_c1")
    out = j.mapInArrow(_applied(False), "_c0 long, n_dropped long, _lines long, _out string")
    return out.select(F.col("_c0").alias("id"), F.col("_lines").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.col("_out").alias("out"))


def drop_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the lines that keep_bitmaps names cut from the texts, and a column n_dropped.

    Texts that lose nothing, nulls among them, and all other columns stay as
    they are; a column called n_dropped, in any case, is replaced.
    """
    docs = without(docs, "n_dropped")
    j = _joined(docs, keep_bitmaps(docs, least_docs, least_chars, keep_first, id_col, text_col), id_col, text_col)
    schema = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out = j.mapInArrow(_applied(True), f"{schema}, n_dropped long, _lines long, _out string")
    text = [F.when(F.col("n_dropped") > 0, F.col("_out")).otherwise(F.col(f"_c{i}")) if c == text_col else F.col(f"_c{i}") for i, c in enumerate(docs.columns)]
    return out.select(*[x.alias(c) for x, c in zip(text, docs.columns, strict=True)], F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
