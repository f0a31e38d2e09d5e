"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Rows are dealt
into blocks of bounded size; each block posts its vectors in one inverted
file per pivot (row, place). A query reads the files of its own pivots and
adds up the footrule distance of the two orders, where a pivot that a row
does not list counts as standing behind its last place. The rows of least
footrule are reranked by their distance, block by block, and the best of all
blocks stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtel.llm.vectors import matrix, usable
from webtel.session import Stages

#: Pivots, a bounded sample; places of an order that are kept; share of a block that is reranked, and at least so many rows.
PIVOTS, PLACES, RERANKED, LEAST = 256, 96, 0.12, 400
#: Rows of a block, queries of a chunk.
BLOCK, CHUNK = 8192, 1024


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of a sample, skipping rows closer than half the median distance to one taken before.

    Many near copies in the data would otherwise take many pivots and say the
    same with each of them.
    """
    square = (sample * sample).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * sample @ sample.T, 0))
    least = np.median(d) / 2
    taken: list[int] = []
    for i in range(len(sample)):
        if len(taken) < n and (d[i, taken] >= least).all():
            taken.append(i)
    return sample[taken]


def orders(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    d = (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :places]


def inverted_files(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and places of each pivot's file, and where the files start."""
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by], np.arange(n_pivots + 1))
    return by // order.shape[1], (by % order.shape[1]).astype(np.int32), starts


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, keep: int, places: int, share: float, least: int):
    """(query, row id, distance) of the best `keep` reranked rows of one block for each query."""
    places = min(places, len(pivots))
    order = orders(rows, pivots, places)
    row, place, starts = inverted_files(order, len(pivots))
    # Without any shared pivot: all of the query's and all of the row's places are moved behind the last.
    apart = places * (places + 1)
    take = min(len(rows), max(least, math.ceil(share * len(rows))))
    out = []
    for q, pivots_of_q in enumerate(orders(queries, pivots, places)):
        foot = np.full(len(rows), apart, dtype=np.int32)
        for at, p in enumerate(pivots_of_q):
            r, there = row[starts[p] : starts[p + 1]], place[starts[p] : starts[p + 1]]
            foot[r] += np.abs(there - at) - (places - at) - (places - there)
        near = np.argpartition(foot, take - 1)[:take] if take < len(rows) else np.arange(len(rows))
        gap = rows[near] - queries[q]
        d = np.sqrt((gap * gap).sum(axis=1))
        best = np.lexsort((ids[near], d))[:keep]
        out.append((np.full(len(best), q), ids[near[best]], d[best]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, places: int = PLACES, share: float = RERANKED, least: int = LEAST) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of `vectors` found for each row of `queries`.

    Both have an id and a vector column. A row is no candidate for the query
    of its own id. Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part. Equal vectors are
    searched once; of equal candidates the k + 1 smallest ids are enough for
    any answer. Ties go to the smaller id. Vectors of another length than
    the most of them are not comparable and take no part. Fewer candidates
    than k give fewer rows; an empty table gives an empty result; other
    columns are ignored.
    """
    stages = Stages(vectors.sparkSession, "ann")
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    rows, asked = clean(vectors), clean(queries)
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    members = stages.write(rows.dropDuplicates(["vec", "id"]).withColumn("r", first).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "members")
    dims = members.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_schema = "query_id long, rank int, id long, distance double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], out_schema)
    points = members.where(F.size("vec") == dims.d).withColumn("node", F.element_at("ids", 1))
    asked = stages.write(asked.where(F.size("vec") == dims.d), "asked")
    texts = asked.groupBy("vec").agg(F.min("id").alias("qnode"))
    n, n_queries = points.count(), asked.count()

    # A bounded sample: pivots come from the 4 * `pivots` vectors of smallest hash.
    sample = np.array([r.vec for r in points.select("vec", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(4 * pivots).collect()], dtype=np.float64)
    sample = spread_out(sample, pivots)
    blocks, chunks = math.ceil(n / BLOCK) or 1, math.ceil(n_queries / CHUNK) or 1
    dealt = points.select(F.lit(False).alias("asks"), "node", "vec", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asking = texts.select(F.lit(True).alias("asks"), F.col("qnode").alias("node"), "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("qnode"), F.lit(chunks)).cast("int").alias("chunk"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        x, ids = matrix(table.column("vec")), table.column("node").to_numpy()
        if asks.all() or not asks.any():
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            q, i, d = search_block(x[~asks], ids[~asks], x[asks], sample, k + 1, places, share, least)
            found = [ids[asks][q], i, d]
        return pa.table({"qnode": pa.array(found[0], pa.int64()), "node": pa.array(found[1], pa.int64()), "distance": pa.array(found[2], pa.float64())})

    hits = dealt.unionByName(asking).groupBy("block", "chunk").applyInArrow(run, "qnode long, node long, distance double")
    best = Window.partitionBy("qnode").orderBy("distance", "node")
    hits = stages.write(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "hits")
    spread = hits.join(points.select("node", "ids"), "node").select("qnode", "distance", F.explode("ids").alias("id"))
    of_query = asked.join(texts, "vec").select(F.col("id").alias("query_id"), "qnode")
    # Each query keeps k of at most (k + 1)**2 rows; the other copies of its vector share them.
    order = Window.partitionBy("qnode").orderBy("distance", "id")
    short = spread.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("qnode").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    own = of_query.join(short, "qnode").withColumn("near", F.slice(F.filter("near", lambda h: h["id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("near").alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("h.id").alias("id"), F.col("h.distance").alias("distance"))
