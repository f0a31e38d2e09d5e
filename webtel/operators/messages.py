"""Deduplication, jobs, set operations and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.operators.numbering import running_total


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def not_seen(df: DataFrame, seen: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows whose key is not in a set of hashes that have not expired."""
    return df.join(seen.where(F.col("expire_at") > now).select(key).distinct(), key, "left_anti")


def suppress(messages: DataFrame, group: str, action: str, unless: dict[str, list[str]]) -> DataFrame:
    """Messages but those whose group also has one of the actions that replace theirs."""
    have = messages.groupBy(group).agg(F.collect_set(action).alias("_have"))  # a page has few kinds of actions
    omit = reduce(lambda a, b: a | b, [(F.col(action) == a) & F.arrays_overlap("_have", F.array(*map(F.lit, bs))) for a, bs in unless.items()], F.lit(False))
    return messages.join(have, group).where(~omit).drop("_have")


def _due(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("ready_at") <= now) & (now < F.col("expire_at")))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that are ready and have not expired, in order of priority and readiness, numbered within their type."""
    return running_total(_due(jobs, now), ["type"], [F.desc("priority"), F.greatest("created_at", "ready_at").asc(), F.asc("job_id")], 1, "position")


def admitted(jobs: DataFrame, most: int) -> DataFrame:
    """The oldest `most` jobs of each type."""
    w = Window.partitionBy("type").orderBy("created_at", "job_id")
    return jobs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def after_run(jobs: DataFrame, outcomes: DataFrame, retries: int = 2) -> DataFrame:
    """State after a run: done, retryable (recoverable and attempts left), or failed."""
    j = jobs.join(outcomes, "job_id", "left")
    state = F.when(F.col("outcome").isNull(), F.col("state")).when(F.col("outcome") == "ok", "done").when((F.col("outcome") == "recoverable") & (F.col("attempts") < retries), "retryable").otherwise("failed")
    return j.withColumn("state", state).withColumn("attempts", F.col("attempts") + F.col("outcome").isNotNull().cast("int")).drop("outcome")


def sampled(df: DataFrame, n: int, seed: int, group: list[str], id_col: str) -> DataFrame:
    """n rows of each group without replacement, by a seeded hash."""
    w = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def recent(df: DataFrame, n: int, group: list[str], last_use: str, tie: str) -> DataFrame:
    """The n rows of each group that were used last."""
    w = Window.partitionBy(*group).orderBy(F.desc(last_use), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def report(checks: DataFrame) -> DataFrame:
    """Counts by category and check with totals, and the worst status of each. Input: category, name, status (0 to 2)."""
    return checks.rollup("category", "name").agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("worst"), F.avg((F.col("status") > 0).cast("double")).alias("error_share"))


def tab_violations(tabs: DataFrame) -> DataFrame:
    """Rows of tab state that break an invariant, with the first that they break."""
    why = (
        F.when(F.col("page_id").isNull(), "no page id")
        .when(~F.coalesce(F.col("depth"), F.lit(0)).isin(0, 1, 2), "depth")
        .when((F.col("depth") == 2) & (F.col("host") != F.col("previous_host")), "depth 2 left its host")
    )
    return tabs.withColumn("violation", why).where("violation is not null")


def next_jobs(jobs: DataFrame, now: Column, cooldowns: DataFrame | None = None) -> DataFrame:
    """Due jobs with `turn`: by priority, and within one the types take turns; types that cool down (type, until) wait."""
    due = _due(jobs, now)
    if cooldowns is not None:
        due = due.join(cooldowns.where(F.col("until") > now).select("type").distinct(), "type", "left_anti")
    return running_total(due, ["type", "priority"], [F.greatest("created_at", "ready_at").asc(), F.asc("job_id")], 1, "turn")


def child_jobs(finished: DataFrame, now: Column, ttl: str = "30 days", job: str = "job_id", children: str = "children") -> DataFrame:
    """New jobs that finished ones return as an array of (type, args): numbered under their parent, ready at once."""
    times = (now.alias("created_at"), now.alias("ready_at"), (now + F.expr(f"INTERVAL {ttl}")).alias("expire_at"))
    rows = finished.select(F.col(job).alias("parent_id"), *times, F.posexplode(children).alias("position", "_c"))
    return rows.select("parent_id", "position", "_c.*", "created_at", "ready_at", "expire_at")
