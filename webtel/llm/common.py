"""What several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.session import Stages

#: Rows of one Arrow batch; texts can be long, so batches hold few rows.
BATCH_ROWS = 1000



def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python task: at most BATCH_ROWS rows and 32 MB in an Arrow batch.

    Spark reads these settings when a query runs, which is after an operator
    has returned, so they stay; tighter ones that a session has are kept.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", 32 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


_held: dict = {}


def worker_held(key: tuple, make: Callable):
    """An object that a Python worker keeps between tasks, such as a cache. A worker keeps one: another key frees it."""
    if key not in _held:
        release_held()
        _held[key] = make()
    return _held[key]


def release_held() -> None:
    """Free what this Python worker keeps, for tasks of operators that keep nothing or something else.

    Workers outlive operators, so a cache would else stay in memory while later operators build their own.
    """
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


#: Largest table that is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, row_bytes: int, lists: str | None = None, item_bytes: int = 8) -> DataFrame:
    """`df`, to be broadcast only if its rows, and the items of a list column, take no more than BROADCAST_BYTES."""
    items = F.sum(F.size(lists)) if lists else F.lit(0)
    n, m = df.agg(F.count(F.lit(1)), F.coalesce(items, F.lit(0))).first()
    return F.broadcast(df) if row_bytes * n + item_bytes * m <= BROADCAST_BYTES else df


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content, for joins where ids may repeat; joined together with the id."""
    return F.xxhash64(*[F.col(c) for c in columns])


def text_key(t: Column) -> Column:
    """A 128-bit key of a text."""
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns of these names, in any case: results of the same name take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 texts of a batch, null as empty, without decoding to str."""
    col = batch.column(column).cast(pa.large_binary())
    return [b"" if v is None else v for v in col.to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65536) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that never cut a group; the input is sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        last = t.num_rows - 1
        same = np.ones(t.num_rows, dtype=bool)
        for k in keys:
            col = t.column(k).to_numpy()
            same &= col == col[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal keys, and the total length as the last entry."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def block_pairs(df: DataFrame, cell: list[str], node: str, block: int, stages: Stages) -> DataFrame:
    """Deal the rows of each cell into pairs of blocks, so that no task gets a whole large cell.

    A cell of more than `block` rows has k = ceil(rows / block) blocks, by a
    hash of `node`; each row goes to the k pairs that hold its own block, so
    any two rows meet in at least one pair. A pair holds about 2 * block
    rows however large its cell is. Adds columns `own`, `bi` and `bj`. The
    sizes of large cells are a written table, of rows / block rows at most;
    Spark broadcasts it only below its own threshold.
    """
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    k = F.coalesce(F.ceil(F.col("_n") / F.lit(block)), F.lit(1)).cast("int")
    dealt = df.join(stages.write(sizes, "large_cells"), cell, "left").withColumn("_k", k)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.col(node)), F.col("_k")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return dealt.withColumn("bi", F.least("own", "_other")).withColumn("bj", F.greatest("own", "_other")).drop("_n", "_k", "_other")


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(link)
    label = np.arange(n)
    reach = link | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def log2_ceil(n: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, n))))
