"""Counting periods whose phase and length differ for each client, and their samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.functions.numbers import first_end, uniform_int


def rotations(visits: DataFrame, client: str, at_ms: str, period_ms: int, tick_ms: int = 60_000, share: float = 0.1, seed: int = 0) -> DataFrame:
    """(client, period, start_ms, end_ms, ended_ms, visits): the periods of each client that have ended.

    A client is first seen at its first visit and waits for a random share of
    a period; nothing is counted until then. The first tick after that starts
    period 1, of `period_ms`. The first tick at or after its end closes a
    period, after which whole periods without any tick are skipped and the
    next begins where they end; its length is `period_ms` give or take
    `share`. Visits in the tick that closes a period count for the next one.

    Visits are summed by client and tick first (a minute), so a client's
    list is bounded by the ticks of the time that the data cover, however
    many visits it has. Rows where client or time is null take no part.
    """
    tick = F.floor(F.col(at_ms) / tick_ms) * tick_ms
    ticks = visits.where(F.col(client).isNotNull() & F.col(at_ms).isNotNull()).groupBy(client, tick.alias("_tick")).agg(F.count(F.lit(1)).alias("_n"))
    lists = ticks.groupBy(client).agg(F.array_sort(F.collect_list(F.struct("_tick", "_n"))).alias("_ticks"))
    period = "struct<period:bigint,start_ms:bigint,end_ms:bigint,ended_ms:bigint,visits:bigint>"
    low, high = round(period_ms * (1 - share)), round(period_ms * (1 + share))

    def state(start: Column, end: Column, no: Column, n: Column, out: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), no.cast("long").alias("no"), n.cast("long").alias("n"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        at, n = x["_tick"], x["_n"]
        waiting = s["no"] == 0
        start = s["end"] + F.floor((at - s["end"]) / period_ms) * period_ms
        length = uniform_int(F.concat_ws(":", F.col(client), s["no"] + 1), low, high, seed)
        done = F.struct(s["no"].alias("period"), s["start"].alias("start_ms"), s["end"].alias("end_ms"), at.alias("ended_ms"), s["n"].alias("visits"))
        return (
            F.when(at < s["end"], state(s["start"], s["end"], s["no"], F.when(waiting, F.lit(0)).otherwise(s["n"] + n), s["out"]))
            .when(waiting, state(at, at + period_ms, F.lit(1), n, s["out"]))
            .otherwise(state(start, start + length, s["no"] + 1, n, F.array_append(s["out"], done.cast(period))))
        )

    first = F.get("_ticks", F.lit(0))["_tick"]
    begin = state(first, first_end(F.col(client), first, period_ms, seed), F.lit(0), F.lit(0), F.array().cast(f"array<{period}>"))
    return lists.select(client, F.explode(F.aggregate("_ticks", begin, step, lambda s: s["out"])).alias("p")).select(client, "p.*")


def counted_in(visits: DataFrame, periods: DataFrame, client: str, at_ms: str, tick_ms: int = 60_000) -> DataFrame:
    """Visits with the number of the client's ended period that counts them; others are left out.

    A period counts the ticks from the one that began it to the one before it
    was closed. Both are joined by client and day, each period posted to the days that it touches.
    """
    day = 86_400_000
    p = periods.withColumn("_from", F.coalesce(F.lag("ended_ms").over(Window.partitionBy(client).orderBy("period")), F.col("start_ms")))
    p = p.select(F.col(client).alias("_client"), "period", "_from", F.col("ended_ms").alias("_to"), F.explode(F.sequence(F.floor(F.col("_from") / day), F.floor(F.col("ended_ms") / day))).alias("_day"))
    tick = F.floor(F.col(at_ms) / tick_ms) * tick_ms
    hit = (F.col(client) == F.col("_client")) & (F.floor(tick / day) == F.col("_day")) & (tick >= F.col("_from")) & (tick < F.col("_to"))
    return visits.join(p, hit).drop("_client", "_from", "_to", "_day")

