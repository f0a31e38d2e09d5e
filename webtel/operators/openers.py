"""Tabs that were opened from others: the opener's state at that time, and whether the new tab's first page confirms its redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a new tab shows before its page is there.
BLANK = "about:blank"


def opener_states(openings: DataFrame, states: DataFrame, columns: list[str], ts: str = "ts", order: str = "order") -> DataFrame:
    """`openings` with opener_* of the state that the opener was in when it opened the tab: an as-of join.

    Openings: tab, opener and ts; states: tab, ts, a number `order` that
    tells states of one time apart, and `columns`. Both are sorted together
    by opener and time, once; the last state at or before an opening counts,
    also if a column of it is null. Without one, all are null. A row is
    never compared with more than its neighbours.
    """
    held = F.struct(*[F.col(c).alias(c) for c in columns])
    s = states.where(F.col("tab").isNotNull()).select(F.col("tab").alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), F.col(order).cast("long").alias("_order"), held.alias("_state"))
    own = F.struct(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(openings.columns)])
    o = openings.select(F.col("opener").alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_order"), own.alias("_own"))
    both = s.unionByName(o, allowMissingColumns=True)
    w = Window.partitionBy("_key").orderBy("_ts", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("_state", F.last("_state", ignorenulls=True).over(w)).where("_kind = 1")
    return j.select(*[F.col(f"_own._c{i}").alias(c) for i, c in enumerate(openings.columns)], *[F.col(f"_state.{c}").alias(f"opener_{c}") for c in columns])


def confirmed(openings: DataFrame, states: DataFrame, ts: str = "ts", order: str = "order") -> DataFrame:
    """Openings with `url`, the first real page of the new tab, `opener_url`, and `redirects` if that page is where they lead.

    `openings` have opener_url and opener_redirects (urls, the last one their
    target) from opener_states; `states` are those of all tabs (tab, ts,
    order, url). A blank page defers the check to the next one. The opener's
    URL only stays if it is http or https.
    """
    later = states.where(F.col("url").isNotNull() & (F.col("url") != BLANK)).select(F.col("tab").alias("_tab"), F.col(ts).alias("_ts"), F.col(order).alias("_order"), F.col("url").alias("_url"))
    first = first_pages(openings, later, ts)
    target = F.element_at("opener_redirects", -1)
    ok = (F.size("opener_redirects") > 0) & (target == F.col("url"))
    return (
        first.withColumn("redirects", F.when(F.coalesce(ok, F.lit(False)), F.col("opener_redirects")))
        .withColumn("opener_url", F.when(F.col("opener_url").rlike("^https?://"), F.col("opener_url")))
        .drop("opener_redirects")
    )


def first_pages(openings: DataFrame, later: DataFrame, ts: str) -> DataFrame:
    """`openings` with `url`: the first of the tab's pages at or after the opening; the mirror image of the as-of join."""
    own = F.struct(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(openings.columns)])
    o = openings.select(F.col("tab").alias("_tab"), F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_order"), F.lit(None).cast("string").alias("_url"), own.alias("_own"))
    p = later.select("_tab", "_ts", F.lit(1).alias("_kind"), F.col("_order").cast("long").alias("_order"), "_url")
    w = Window.partitionBy("_tab").orderBy("_ts", "_kind", "_order").rowsBetween(0, Window.unboundedFollowing)
    j = o.unionByName(p, allowMissingColumns=True).withColumn("_next", F.first("_url", ignorenulls=True).over(w)).where("_kind = 0")
    return j.select(*[F.col(f"_own._c{i}").alias(c) for i, c in enumerate(openings.columns)], F.col("_next").alias("url"))
