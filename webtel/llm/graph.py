"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtel.session import Stages


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, stages: Stages, max_rounds: int = 40) -> DataFrame:
    """Rows (u, v): each node that isn't the smallest of its component, and that smallest node.

    `edges` has long columns u and v in any order; loops, repeats and nulls
    are ignored. Each round is a large-star and a small-star step (joins
    and minimum aggregates); its edges and minima are written to the shared
    folder, so lineage stays short, both sides of each join are plain
    exchanges, where Spark can split the node of a large star, and nothing
    passes through the driver but a count and a checksum.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stages.write(e, "edges0")
    seen = _signature(e)
    if seen[0] == 0:
        return e
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stages.write(large, f"large{k}")
        low = stages.write(large.groupBy("u").agg(F.min("v").alias("m")), f"low{k}")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = stages.write(small, f"edges{k}")
        now = _signature(e)
        stages.drop(f"edges{k - 1}", f"least{k}", f"large{k}", f"low{k}")
        if now == seen:
            return e
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
