"""Job queues as a table of states that each batch of new jobs and outcomes replaces by its next version."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.functions.numbers import uniform_int
from webtel.operators.numbering import running_total

DAY_MS = 86_400_000
STATE = "job_id string, type string, state string, created_ms long, ready_ms long, expire_ms long, attempts_left int, queued_ms long"
#: States of jobs that still take up room; others are results of the version in which they appear.
ALIVE = ("waiting", "ready", "retryable", "running")


@dataclass(frozen=True)
class Limits:
    """Jobs of a type and of all types, retries after an error, the usual time to live and the longest."""

    per_type: int = 1_000
    total: int = 10_000
    retries: int = 2
    ttl_ms: int = 14 * DAY_MS
    most_ttl_ms: int = 180 * DAY_MS


def restored(state: DataFrame, now: Column, restart: bool = False) -> DataFrame:
    """The jobs that are still alive at `now`, others marked: `expired`, or `purged` if created over a day ahead (a clock that jumped).

    After a restart, jobs that were running are `lost`: whether they had an effect is unknown.
    """
    alive = state.where(F.col("state").isin(*ALIVE))
    end = F.when(F.col("created_ms") >= now + DAY_MS, "purged").when(F.lit(restart) & (F.col("state") == "running"), "lost").when(F.col("expire_ms") <= now, "expired")
    return alive.withColumn("state", F.coalesce(end, F.col("state")))


def after_outcomes(state: DataFrame, outcomes: DataFrame, now: Column, limits: Limits) -> DataFrame:
    """States after runs with outcomes (job_id, outcome): `ok`, `recoverable` or anything else.

    A recoverable failure with attempts left waits as `retryable`, else the
    job is `failed`. Each success of a type puts the retryable job that has
    waited longest back to `ready`.
    """
    o = outcomes.select("job_id", "outcome").dropDuplicates(["job_id"])
    j = state.join(o, "job_id", "left")
    ran = F.col("outcome").isNotNull() & F.col("state").isin(*ALIVE)
    left = F.when(F.col("attempts_left").isNull(), F.lit(limits.retries)).otherwise(F.col("attempts_left") - 1)
    again = ran & (F.col("outcome") == "recoverable") & (left > 0)
    j = j.select(
        "job_id",
        "type",
        F.when(again, "retryable").when(ran & (F.col("outcome") == "ok"), "done").when(ran, "failed").otherwise(F.col("state")).alias("state"),
        "created_ms",
        F.when(again, now).otherwise(F.col("ready_ms")).alias("ready_ms"),
        "expire_ms",
        F.when(again, left).otherwise(F.col("attempts_left")).cast("int").alias("attempts_left"),
        F.when(again, now).otherwise(F.col("queued_ms")).alias("queued_ms"),
    )
    successes = j.where("state = 'done'").groupBy("type").agg(F.count(F.lit(1)).alias("_ok"))
    waiting = running_total(j.where("state = 'retryable'"), ["type"], [F.asc("queued_ms"), F.asc("created_ms"), F.asc("job_id")], 1, "_turn")
    waiting = waiting.join(successes, "type", "left").withColumn("state", F.when(F.col("_turn") <= F.col("_ok"), "ready").otherwise(F.col("state"))).select(*j.columns)
    return j.where("state <> 'retryable'").unionByName(waiting)


def registered(state: DataFrame, new: DataFrame, now: Column, limits: Limits, seed: int = 0) -> DataFrame:
    """`state` with new jobs: `waiting`, or why not: `bad config`, `expired`, `local limit`, `global limit`.

    New jobs: job_id, type, order, and each null where not given: ready_ms,
    min_ms and max_ms (a delay, drawn between them), expire_ms, ttl_ms. A job
    that is in the state already is not registered again. Beyond the limit of
    its type, a new job takes the place of the retryable one that has waited
    longest (`dropped`), as long as there are any.
    """
    latest = F.coalesce("max_ms", "min_ms")
    bad = F.coalesce((F.col("min_ms") < 0) | (F.col("max_ms").isNotNull() & F.col("min_ms").isNull()) | (latest > limits.most_ttl_ms) | (latest < F.col("min_ms")), F.lit(False)) | F.col("type").isNull()
    delay = F.when(latest == F.col("min_ms"), F.col("min_ms")).otherwise(F.col("min_ms") + F.floor(uniform_int(F.col("job_id"), 0, (1 << 30) - 1, seed) / float(1 << 30) * (latest - F.col("min_ms") + 1)))
    expire = F.least(F.coalesce("expire_ms", now + F.coalesce("ttl_ms", F.lit(limits.ttl_ms))), now + limits.most_ttl_ms)
    n = new.where(F.col("job_id").isNotNull()).join(state.select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"])
    n = n.select("job_id", "type", F.when(bad, "bad config").when(expire <= now, "expired").otherwise("waiting").alias("state"), now.alias("created_ms"), F.coalesce("ready_ms", now + delay, F.lit(0)).cast("long").alias("ready_ms"), expire.cast("long").alias("expire_ms"), F.lit(None).cast("int").alias("attempts_left"), F.lit(None).cast("long").alias("queued_ms"), "order")

    alive = F.col("state").isin(*ALIVE)
    room = state.where(alive).groupBy("type").agg(F.count(F.lit(1)).alias("_alive"), F.count_if(F.col("state") == "retryable").alias("_retryable"))
    asked = running_total(n.where("state = 'waiting'"), ["type"], [F.asc("order"), F.asc("job_id")], 1, "_i").join(room, "type", "left").fillna(0, ["_alive", "_retryable"])
    free = F.greatest(F.lit(limits.per_type) - F.col("_alive"), F.lit(0))
    local = asked.withColumn("_over", F.greatest(F.col("_i") - free, F.lit(0))).withColumn("state", F.when(F.col("_over") > F.col("_retryable"), "local limit").otherwise(F.col("state")))
    gone = local.where("state = 'waiting'").groupBy("type").agg(F.max("_over").alias("_gone")).where("_gone > 0")
    oldest = running_total(state.where("state = 'retryable'"), ["type"], [F.asc("queued_ms"), F.asc("created_ms"), F.asc("job_id")], 1, "_turn").join(gone, "type", "left")
    oldest = oldest.withColumn("state", F.when(F.col("_turn") <= F.col("_gone"), "dropped").otherwise(F.col("state"))).select(*state.columns)
    kept = state.where("state <> 'retryable'").unionByName(oldest)

    used = kept.where(alive).agg(F.count(F.lit(1)).alias("_used"))
    fits = running_total(local.where("state = 'waiting'"), [], [F.asc("order"), F.asc("job_id")], 1, "_all").join(F.broadcast(used))  # one row
    fits = fits.withColumn("state", F.when(F.col("_used") + F.col("_all") > limits.total, "global limit").otherwise(F.col("state")))
    parts = (n.where("state <> 'waiting'"), local.where("state <> 'waiting'"), fits)
    out = kept
    for p in parts:
        out = out.unionByName(p.select(*state.columns))
    return out


def next_version(state: DataFrame, new: DataFrame, outcomes: DataFrame, now: Column, limits: Limits, restart: bool = False) -> DataFrame:
    """One version after another: what is over goes, then outcomes, then new jobs."""
    return registered(after_outcomes(restored(state, now, restart), outcomes, now, limits), new, now, limits)


class JobTable:
    """Versions of the state in a shared folder, one for each batch.

    Version n is computed from the last one before it and overwrites what a
    failed attempt may have left, so that a batch that is repeated changes
    nothing. A version counts once its folder is complete. The versions
    before the last two are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, limits: Limits):
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [re.fullmatch(r"v=(\d+)", x.getPath().getName()) for x in fs.listStatus(path)]
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={n}/_SUCCESS"))
        return sorted(int(m[1]) for m in found if m and done(int(m[1])))

    def version(self, before: int | None = None) -> DataFrame:
        """The last version, or the last one before a number; empty if there is none."""
        known = [v for v in self._versions() if before is None or v < before]
        reader = self.spark.read.schema(STATE)
        return reader.parquet(f"{self.root}/v={known[-1]}") if known else self.spark.createDataFrame([], STATE)

    def apply(self, batch: DataFrame, number: int, restart: bool = False) -> None:
        """A batch of rows with kind `new` or `outcome` and `now_ms`, the clock of its last row."""
        now = batch.agg(F.max("now_ms")).first()[0]
        if now is None:
            return
        out = next_version(self.version(number), batch.where("kind = 'new'"), batch.where("kind = 'outcome'"), F.lit(now), self.limits, restart)
        out.write.mode("overwrite").parquet(f"{self.root}/v={number}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in [v for v in self._versions() if v < number][:-1]:
            p = path(f"{self.root}/v={old}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply what a stream has, batch by batch, and stop."""
        q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: self.apply(df, n)).start()
        q.awaitTermination()
