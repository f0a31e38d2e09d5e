"""Popularity counts, votes and samples; activity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.functions import text, times, urls
from webtel.functions.numbers import uniform_int
from webtel.operators.numbering import running_total


def projections(visits: DataFrame, url: str = "url") -> DataFrame:
    """Each visit as (projection, key): its registrable domain, its host, and host with path."""
    u = F.col(url)
    host = urls.part(u, "host")
    rows = F.array(
        F.struct(F.lit("domain").alias("projection"), urls.registrable_domain(host).alias("key")),
        F.struct(F.lit("host").alias("projection"), host.alias("key")),
        F.struct(F.lit("path").alias("projection"), F.concat(host, urls.part(u, "path")).alias("key")),
    )
    return visits.withColumn("_p", F.explode(rows)).select("*", "_p.*").drop("_p").where("key is not null")


def counts(visits: DataFrame, *by: str) -> DataFrame:
    return visits.groupBy(*by, "projection", "key").agg(F.count(F.lit(1)).alias("n"))


def top(counted: DataFrame, k: int, by: list[str], n: str = "n", tie: str = "key") -> DataFrame:
    """The k largest of each group, ties by name; groups are limited before they are shuffled."""
    w = Window.partitionBy(*by).orderBy(F.desc(n), tie)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def periods(events: DataFrame, ts: str, every: str, *by: str) -> DataFrame:
    """Counts in whole periods since the epoch (1 day, 7 days, 28 days)."""
    g = events.groupBy(F.window(ts, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("period_start"), *by, "n")


def cooled_down(visits: DataFrame, tab: str, order: list[str], ts: str, host: str, is_history: Column, seconds: int = 20) -> DataFrame:
    """Visits but history navigations to the host that the tab left less than 20 seconds ago."""
    w = Window.partitionBy(tab).orderBy(*order)
    again = is_history & (F.lag(host).over(w) == F.col(host)) & (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) < seconds * 1_000_000)
    return visits.withColumn("_again", F.coalesce(again, F.lit(False))).where(~F.col("_again")).drop("_again")


def bernoulli(df: DataFrame, one_in: int, id_col: str, seed: int | None = None) -> DataFrame:
    """One row in so many: at random with a seed, else the rows whose hash says so, the same in every run."""
    if seed is not None:
        return df.where(F.rand(seed) < 1.0 / one_in)
    return df.where(uniform_int(F.col(id_col), 0, one_in - 1) == 0)


def weighted_picks(counted: DataFrame, picks: DataFrame, n: str = "n", key: str = "key", group: str | None = None) -> DataFrame:
    """Keys at given positions of the counts laid end to end: a sample with replacement by count.

    `picks` has `group` (if any) and `position` from 0 below the total. Keys
    and picks meet by equality in slots as wide as a group's mean count, so
    that a span is posted to its slots, in all at most two rows for each key,
    and a pick meets the keys of its slot only, not all of its group.
    """
    own = F.col(group) if group else F.lit(0)
    stats = counted.groupBy(own.alias("_g")).agg(F.greatest(F.ceil(F.sum(n) / F.count(F.lit(1))), F.lit(1)).alias("_width"))
    spans = running_total(counted.where(F.col(n) > 0), [group] if group else [], [F.asc(key)], F.col(n), "_end").select(F.col(key).alias("_key"), own.alias("_g"), (F.col("_end") - F.col(n)).alias("_start"), "_end")
    slots = F.sequence(F.floor(F.col("_start") / F.col("_width")), F.floor((F.col("_end") - 1) / F.col("_width")))
    posted = spans.join(stats, "_g").select("_key", "_start", "_end", F.col("_g").alias("_group"), F.explode(slots).alias("_slot"))
    p = picks.withColumn("_g", own).join(stats, "_g").withColumn("_at", F.floor(F.col("position") / F.col("_width")))
    hit = (F.col("_g") == F.col("_group")) & (F.col("_at") == F.col("_slot")) & (F.col("position") >= F.col("_start")) & (F.col("position") < F.col("_end"))
    return p.join(posted, hit).select(*picks.columns, F.col("_key").alias(key))


def with_noise(c: Column, low: float, high: float, seed: int | None) -> Column:
    """A value times a uniform factor; without a seed the value itself."""
    return c if seed is None else c * (low + F.rand(seed) * (high - low))


def ranking(votes: DataFrame) -> DataFrame:
    """Keys by votes and by votes weighted with activity."""
    return votes.groupBy("key").agg(F.sum("votes").alias("votes"), F.sum(F.col("votes") * F.col("activity")).alias("weight"))


def legal_votes(votes: DataFrame) -> Column:
    """Why a vote is refused; null if it is legal."""
    return (
        F.when(~F.col("projection").isin("domain", "host", "path"), "projection")
        .when(~F.col("interval").isin("1d", "1w", "4w"), "interval")
        .when(~F.col("votes").between(0, 3), "votes")
        .when((F.col("activity") < 0) | (F.col("activity") != F.floor("activity")), "activity")
    )


def dwell(events: DataFrame, key: str, order: list[str], ts: str, cap_seconds: float = 60.0) -> DataFrame:
    """Seconds until the next event of the same key, at most the cap; the last event has the cap."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return events.withColumn("dwell", F.least(F.coalesce(gap, F.lit(cap_seconds)), F.lit(cap_seconds)))


def activity(events: DataFrame, key: str, dwell_col: str, bucket: str, is_load: Column, load_seconds: float = 5.0, full_seconds: float = 1200.0) -> DataFrame:
    """Score in [0, 1] per key: dwell and five seconds for each bucket with a load, over 20 minutes."""
    per = events.groupBy(key, bucket).agg(F.sum(dwell_col).alias("s"), F.max(is_load.cast("int")).alias("l"))
    total = F.sum(F.col("s") + F.col("l") * load_seconds)
    return per.groupBy(key).agg(F.least(total / full_seconds, F.lit(1.0)).alias("activity"))


def live_buckets(events: DataFrame, ts: str, now_ms: Column, n: int = 7) -> DataFrame:
    """Events of the newest buckets."""
    b = times.bucket(F.col(ts))
    now = F.floor(now_ms / times.BUCKET_MS)
    return events.withColumn("bucket", b).where(F.col("bucket").between(now - n, now))


#: One in so many visits is sampled locally, by interval.
LOCAL_SAMPLING = {"1d": 1, "1w": 10, "4w": 100}


def activity_total(counted: DataFrame, *by: str, interval: str = "interval", n: str = "n") -> DataFrame:
    """The visits that sampled counts stand for: the population times the factor of its interval."""
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in LOCAL_SAMPLING.items() for x in pair]), F.col(interval))
    return counted.groupBy(*by, interval).agg(F.sum(n).alias("_n")).select(*by, interval, (F.col("_n") * factor).cast("long").alias("activity"))


def prepared_votes(votes: DataFrame, verdicts: DataFrame, countries: tuple[str, ...], mask=None) -> DataFrame:
    """Votes ready to send: (projection, interval, vote, country); those for something that is no host name are refused.

    Votes: projection, interval, key, country. `mask` is a column function
    for the parts of a path. A vote without a quorum (verdicts: hash,
    reached) becomes two hyphens, as does a country that is not allowed.
    """
    pieces = F.split("key", "/")
    host = F.get(pieces, F.lit(0))
    path = F.when(F.col("projection") == "path", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    legal = text.is_hostname(host) & ((F.col("projection") == "path") | (F.size(pieces) == 1)) & F.col("projection").isin("domain", "host", "path")
    v = votes.where(legal).withColumn("vote", F.array_join(F.concat(F.array(host), F.transform(path, mask) if mask else path), "/"))
    seen = verdicts.select(F.col("hash").alias("_hash"), F.col("reached").alias("_reached"))
    v = v.withColumn("_hash", F.sha1("vote")).join(seen, "_hash", "left")
    vote = F.when(F.coalesce("_reached", F.lit(False)), F.col("vote")).otherwise("--")
    return v.select("projection", "interval", vote.alias("vote"), text.country(F.col("country"), countries).alias("country"))


def bucket_violations(buckets: DataFrame, client: str, bucket: str, seconds: str, most: int = 7, least: int = 0) -> DataFrame:
    """(client, violation): activity states with too many buckets, repeated ones, or times that are no times.

    States of fewer than `least` buckets are not judged.
    """
    per = buckets.groupBy(client).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(bucket).alias("d"), F.count_if(F.coalesce((F.col(seconds) < 0) | F.isnan(seconds), F.lit(True)) | F.col(bucket).isNull()).alias("bad"))
    why = F.when(F.col("bad") > 0, "invalid state").when(F.col("n") > F.col("d"), "repeated bucket").when(F.col("n") > most, "bucket overrun")
    return per.where(F.col("n") >= least).select(client, why.alias("violation")).where("violation is not null")
