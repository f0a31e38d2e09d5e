"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Each of T tables has a random projection and k random planes. A vector's
sides of the planes give the table's cell, in which vectors are sorted by
projection; two vectors collide in the table if they share the cell and the
projection of one lies in a window around that of the other. Pairs that
collide in at least c tables are verified by their cosine. T, k and c come
from the chance that a pair just at the threshold collides: it is missed
with at most the given probability. A pair is handled in the first table
where it collides, so no list of pairs is kept: tasks return link counts
and spanning forests of the pairs that they have verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import block_pairs, forest, group_starts, whole_groups
from webtel.llm.graph import connected_components
from webtel.llm.vectors import matrix, unit, usable
from webtel.session import Stages

BLOCK = 256
SEED = 20240229


def calibrate(rows: int, cosine: float, miss: float = 1e-5, count: int = 2, per_cell: int = 64) -> tuple[int, int, int, float]:
    """(planes k, tables T, collisions c, window half-width) for the largest label of so many rows.

    k gives about `per_cell` chance rows in a cell. At the threshold, the
    chance of a collision is (1 - angle / pi)**k for the cell times that of
    a normal variable within two standard deviations; T is the least number
    of tables with a binomial chance of fewer than c collisions below `miss`.
    """
    k = max(4, min(24, round(math.log2(max(rows, 1) / per_cell)))) if rows > per_cell else 4
    width = 2 * math.sqrt(2 - 2 * cosine)
    p = (1 - math.acos(cosine) / math.pi) ** k * math.erf(math.sqrt(2))
    for t in range(count, 2000):
        if sum(math.comb(t, i) * p**i * (1 - p) ** (t - i) for i in range(count)) <= miss:
            return k, t, count, width
    raise ValueError("the threshold is too low for this method")


def _projections(dim: int, k: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, t)), rng.standard_normal((dim, t * k))


def _signatures(x: np.ndarray, k: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and projections of unit vectors in each table."""
    lines, planes = _projections(x.shape[1], k, t)
    sides = (x @ planes >= 0).reshape(len(x), t, k)
    return sides @ (1 << np.arange(k)), x @ lines


def _cells(k: int, t: int):
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                cell, _ = _signatures(unit(matrix(part.column("vec"))), k, t)
                at = np.repeat(np.arange(part.num_rows), t)
                rows = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.tile(np.arange(t, dtype=np.int32), part.num_rows)), pa.array(cell.ravel().astype(np.int64))], [*part.schema.names, "tab", "cell"])

    return run


def _verify(tables, k: int, t: int, count: int, width: float, cosine: float):
    keys = ("label", "dim", "tab", "cell", "bi", "bj")
    for table in tables:
        col = {c: table.column(c).to_numpy() for c in (*keys, "own", "node", "copies")}
        starts = group_starts([col[c] for c in keys])
        vectors = table.column("vec").combine_chunks()
        us, vs, ns = [], [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            x = unit(matrix(vectors.slice(s, e - s)))
            tab, own, node, copies = int(col["tab"][s]), col["own"][s:e], col["node"][s:e], col["copies"][s:e]
            cell, line = _signatures(x, k, t)
            order = np.argsort(line[:, tab], kind="stable")
            at = line[order, tab]
            # The window of each row in sorted order: those after it within the width.
            last = np.searchsorted(at, at + width, side="right")
            reach = last - np.arange(len(at)) - 1
            i = np.repeat(np.arange(len(at)), reach)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
            i, j = order[i], order[j]
            if col["bi"][s] != col["bj"][s]:
                apart = own[i] != own[j]
                i, j = i[apart], j[apart]
            cut, cos = 1 << 16, []
            for p in range(0, len(i), cut):
                a, b = i[p : p + cut], j[p : p + cut]
                hit = (cell[a] == cell[b]) & (np.abs(line[a] - line[b]) <= width)
                ok = (hit.sum(axis=1) >= count) & (hit.argmax(axis=1) == tab)
                cos.append(np.where(ok, 0.0, -2.0))
                cos[-1][ok] = (x[a[ok]] * x[b[ok]]).sum(axis=1)
            if not cos:
                continue
            good = np.concatenate(cos) >= cosine
            i, j = i[good], j[good]
            if not len(i):
                continue
            near = np.zeros((e - s, e - s), dtype=bool)
            near[i, j] = near[j, i] = True
            degree = np.bincount(i, copies[j], e - s) + np.bincount(j, copies[i], e - s)
            root = forest(near)
            some = np.flatnonzero(degree)
            us.append(node[some])
            vs.append(node[root[some]])
            ns.append(degree[some].astype(np.int64))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ns)], ["u", "v", "n"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of `vectors`: (id, n_links, component_id).

    Links join vectors of one label (not null) and one length at or above
    the cosine. Vectors that are null, zero or hold null or non-finite
    components, and rows with a null label or id, have no links and are
    components of their own. Equal vectors are compared once and count as
    often as they stand. An empty table gives an empty result; other
    columns are ignored.
    """
    stages = Stages(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("long").alias("label"))
    takes_part = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = rows.where(takes_part)
    points = good.groupBy("label", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    points = stages.write(points.withColumn("dim", F.size("vec").cast("long")), "points")
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, t, count, width = calibrate(largest, cosine)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", tab int, cell long"
    cells = points.mapInArrow(_cells(k, t), schema)
    group = ["label", "dim", "tab", "cell"]
    keys = [*group, "bi", "bj"]
    dealt = block_pairs(cells, group, "node", BLOCK, stages).repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
    linked = dealt.mapInArrow(lambda it: _verify(whole_groups(it, keys, 8192), k, t, count, width, cosine), "u long, v long, n long")
    linked = stages.write(linked, "linked")
    comp = connected_components(linked.select("u", "v"), stages)
    totals = linked.groupBy("u").agg(F.sum("n").alias("n"))
    named = points.join(totals, points.node == totals.u, "left").drop("u").join(comp, points.node == comp.u, "left")
    named = stages.write(named.select("label", "vec", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", "node").alias("component_id")), "named")
    out = good.join(named, ["label", "vec"]).select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    rest = rows.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest)
