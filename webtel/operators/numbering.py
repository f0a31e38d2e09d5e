"""Running totals of large ordered groups that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.session import Stages


def running_total(df: DataFrame, group: list[str], order: list[Column], amount: Column | int, name: str) -> DataFrame:
    """`df` with the total of `amount` up to and including each row, in an order within a group (none: the whole table).

    Rows are cut into ranges of the order and written, so that a range keeps
    its number; each range sums by itself, and starts at the total of the
    ranges before it, of which there is one row for each range and group.
    """
    stages = Stages(df.sparkSession, "running")
    cut = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    cut = stages.write(cut.withColumn("_amount", F.lit(amount).cast("long")), "ranges")
    sizes = cut.groupBy(*group, "_range").agg(F.sum("_amount").alias("_own"))
    before = Window.partitionBy(*group).orderBy("_range")
    starts = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), (F.sum("_own").over(before) - F.col("_own")).alias("_start"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_range") == F.col("_r")]
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_within", F.sum("_amount").over(within)).join(starts, same)
    return out.withColumn(name, F.col("_start") + F.col("_within")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)
