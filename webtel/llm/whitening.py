"""Whitening of vectors by a one-sided Jacobi SVD of centred rows.

Rows are whole numbers, so sums, centring and deviations are exact. Each task
compresses its centred rows block by block to a triangle R (QR), triangles
are merged in a tree until a few are left, and plane rotations make the
columns of the last one orthogonal: their lengths are standard deviations
times the root of the number of rows, and the accumulated rotations are the
components. No product of rows with themselves is formed, so small deviations
keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import small_batches
from webtel.session import Stages

#: Triangles that meet in one task, or at last on the driver.
FAN_IN = 64
#: Largest magnitude of a component times `scale`, so that sums of whole numbers stay whole.
LARGEST = float(1 << 44)


def whole_numbers(v: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each component."""
    return F.transform(v, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(shift).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for start in range(0, b.num_rows, rows):
            part = b.slice(start, rows)
            x = part.column("x")
            yield part, np.asarray(x.flatten(), dtype=np.int64).reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension, and as dimension -1 the number of rows."""
    n, total = 0, None
    for _, x in _blocks(batches):
        n += len(x)
        total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.append(n, total))], ["dimension", "s"])


class Centre:
    """Number of rows and sums; centred rows without rounding before the last step."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.sums = np.array(sums, dtype=np.int64)
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([s % n / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2; null if it is beyond a long."""
        near = (self.rows(x) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            exact = ((self.n * x - self.sums) ** 2).sum(axis=1)
        return pa.array(exact, pa.int64(), mask=near >= 2.0**63 * (1 - 1e-9))


def _triangle(r: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    return np.linalg.qr(more if r is None else np.vstack([r, more]), mode="r")


def _compressed(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _blocks(batches):
            r = _triangle(r, centre.rows(x))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"])

    return run


def _merged(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for one in b.column("r"):
                r = _triangle(r, np.asarray(one.values).reshape(-1, width))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"])

    return run


def tall_qr(fit: DataFrame, centre: Centre, stages: Stages) -> np.ndarray:
    """R of the QR of all centred rows: one triangle for a task, merged FAN_IN at a time."""
    width = len(centre.sums)
    r = stages.write(fit.mapInArrow(_compressed(centre), "r array<double>"), "r0")
    n, level = r.count(), 0
    while n > FAN_IN:
        level += 1
        r = stages.write(r.repartition(-(-n // FAN_IN)).mapInArrow(_merged(width), "r array<double>"), f"r{level}")
        stages.drop(f"r{level - 1}")
        n = r.count()
    last = None
    for row in r.toLocalIterator():
        last = _triangle(last, np.array(row.r).reshape(-1, width))
    return last


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns.

    Pairs of columns are rotated until all are orthogonal, half of the
    columns with the other half at once: in a sweep every two meet.
    """
    a = np.array(r, dtype=np.float64)
    d = a.shape[1]
    v = np.eye(d)
    ring = np.arange(d + d % 2)
    near = max(d, 8) * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > near
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            ring[1:] = np.roll(ring[1:], 1)
        if worst <= near:
            break
    else:
        raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")
    length = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order] / np.sqrt((v[:, order] ** 2).sum(axis=0))


def _products(centre: Centre, axes: np.ndarray):
    """Sums of products of whitened components, and with j = -1 their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        total = np.zeros((k, k + 1))
        for _, x in _blocks(batches):
            w = centre.rows(x) @ axes
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        j[:, k] = -1
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _whitened(centre: Centre, axes: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for part, x in _blocks(batches):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n, np.int64)),
                    centre.deviations(x).take(each),
                    pa.array((centre.rows(x) @ axes).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


_RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Components are fitted to the distinct vectors, each once; every row,
    repeated ones too, is then whitened. Vectors that are null, empty or
    hold null or non-finite entries take no part; zero vectors do. If
    lengths differ, the most frequent length among distinct vectors counts,
    the larger one of ties, and others take no part. Components without
    deviation (fewer distinct vectors than dimensions) are left out, so a
    single distinct vector or an empty table gives no row. Entries beyond
    2^44 / scale count as that; deviation is null where it is beyond a long.
    Ids may be null or repeat; other columns, whatever their names, are
    ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    stages = Stages(spark, "whiten")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    rows = rows.select("id", whole_numbers(F.col("v"), scale, shift).alias("x"))
    fit = stages.write(rows.select("x").distinct(), "fit")
    usual = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return rows.limit(0).mapInArrow(lambda it: iter(()), _RESULT)
    fit = fit.where(F.size("x") == usual.d)
    sums = {r.dimension: r.s for r in fit.mapInArrow(_sums, "dimension int, s long").groupBy("dimension").agg(F.sum("s").alias("s")).collect()}
    centre = Centre(sums[-1], [sums[i] for i in range(usual.d)])

    length, axes = jacobi(tall_qr(fit, centre, stages))
    k = min(components, int((length > usual.d * np.finfo(float).eps * length[0]).sum()))
    explained = (length**2 / (length**2).sum())[:k] if k else length[:0]
    axes = axes[:, :k] / (length[:k] / np.sqrt(centre.n)) if k else axes[:, :0]
    error = 0.0
    if k:
        cov = np.zeros((k, k + 1))
        for r in fit.mapInArrow(_products(centre, axes), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            cov[r.i, r.j] = r.s / centre.n
        error = float(np.abs(cov[:, :k] - np.outer(cov[:, k], cov[:, k]) - np.eye(k)).max())
    return rows.where(F.size("x") == usual.d).mapInArrow(_whitened(centre, axes, explained, error), _RESULT)
