"""Pages: sessions of tabs, merging, gates, quorum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.functions import sanitize


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of events with no longer gap between them."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).select(key, "start", "end", "n")


def previous(events: DataFrame, tab: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each event with earlier values of its tab, as previous_*."""
    w = Window.partitionBy(tab).orderBy(*order)
    return events.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def search_depth(events: DataFrame, tab: str, order: list[str], is_search: Column, host: Column) -> DataFrame:
    """depth 0 for a search page, 1 for the page after it, 2 for the next if it stays on that host; else null."""
    w = Window.partitionBy(tab).orderBy(*order)
    e = events.withColumn("_s", F.coalesce(is_search, F.lit(False))).withColumn("_h", host)
    e = e.withColumn("_one", ~F.col("_s") & F.coalesce(F.lag("_s").over(w), F.lit(False)))
    two = ~F.col("_s") & ~F.col("_one") & F.coalesce(F.lag("_one").over(w), F.lit(False)) & (F.lag("_h").over(w) == F.col("_h"))
    depth = F.when(F.col("_s"), 0).when(F.col("_one"), 1).when(two, 2)
    return e.withColumn("depth", depth).drop("_s", "_h", "_one")


def redirect_chains(events: DataFrame, tab: str, order: list[str], is_redirect: Column, url: str, most: int = 8) -> DataFrame:
    """For each landing, the URLs of the redirects before it, the first `most` and then a mark for more."""
    w = Window.partitionBy(tab).orderBy(*order)
    e = events.withColumn("_r", F.coalesce(is_redirect, F.lit(False)))
    e = e.withColumn("_run", F.sum(F.when(~F.col("_r"), 1).otherwise(0)).over(w) - F.when(~F.col("_r"), 1).otherwise(0))
    run = Window.partitionBy(tab, "_run")
    # Only the first redirects of a run are collected, one more than are shown.
    e = e.withColumn("_at", F.row_number().over(run.orderBy(*order)))
    e = e.withColumn("_chain", F.collect_list(F.when(F.col("_r") & (F.col("_at") <= most + 1), F.struct("_at", F.col(url).alias("u")))).over(run)).where(~F.col("_r"))
    urls = F.transform(F.array_sort("_chain"), lambda x: x["u"])
    chain = F.when(F.size("_chain") > most, F.array_append(F.slice(urls, 1, most), F.lit("..."))).otherwise(urls)
    return e.withColumn("redirects", chain).drop("_r", "_run", "_at", "_chain")


def merge(pages: DataFrame, key: str, order: list[str], last: list[str], depth: str | None = None, firsts: dict[str, str] | None = None) -> DataFrame:
    """One row per key: the last value that is not null of each column; a search of depth 1 beats later ones.

    `firsts` maps columns to min or max.
    """
    at = F.struct(*order)
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    if depth:
        rank = F.struct((F.col(depth) == 1).alias("_d"), *order)
        picks.append(F.max_by(depth, F.when(F.col(depth).isNotNull(), rank)).alias(depth))
    picks += [getattr(F, how)(c).alias(f"{how}_{c}") for c, how in (firsts or {}).items()]
    return pages.groupBy(key).agg(*picks)


def expiring(pages: DataFrame, now: Column, hold: str = "1 hour") -> DataFrame:
    """Pages held long enough, with why they are not published: no structure, incomplete, noindex, a search page."""
    p = pages.where(F.col("created") + F.expr(f"INTERVAL {hold}") <= now)
    why = (
        F.when(F.col("title").isNull(), "no structure")
        .when(F.col("status") != "complete", "incomplete")
        .when(F.coalesce(F.col("noindex"), F.lit(False)) & (F.col("load_method") != "history-navigation"), "noindex")
        .when(F.col("depth") == 0, "search page")
    )
    return p.withColumn("rejected", why)


def visibility(url: Column, is_search: Column, is_local: Column) -> Column:
    return F.when(~F.coalesce(url.rlike("^https?://"), F.lit(False)), "private").when(is_search, "public").when(is_local, "private").otherwise("unknown")


def urls_to_vote(url: Column, ref: Column, redirects: Column) -> Column:
    """Distinct URLs of a page that need a quorum: itself, its referrer, its redirects but for the mark."""
    return F.array_distinct(F.filter(F.concat(F.array(url, ref), F.coalesce(redirects, F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != "...")))


def quorum(votes: DataFrame, text: str, client: str, k: int, out: str = "reached") -> DataFrame:
    """(hash, clients, reached): texts by their SHA-1, the number of distinct clients, and whether there are k."""
    v = votes.where(F.col(text).isNotNull()).select(F.sha1(text).alias("hash"), client)
    n = F.countDistinct(client)
    return v.groupBy("hash").agg(n.alias("clients")).withColumn(out, F.col("clients") >= k)


def publishable(pages: DataFrame, verdicts: DataFrame, url: str = "url") -> DataFrame:
    """Pages with `published_url`: whole with a quorum, else only scheme and host."""
    v = verdicts.select(F.col("hash").alias("_hash"), F.col("reached").alias("_reached"))
    j = pages.withColumn("_hash", F.sha1(url)).join(v, "_hash", "left")
    return j.withColumn("published_url", sanitize.protect(F.col(url), F.coalesce("_reached", F.lit(False)))).drop("_hash", "_reached")


def before_and_after(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    """Stored pages joined with their anonymous copies, with the reason why they differ."""
    fields = ("url", "title", "noindex")
    b = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"before_{c}") for c in fields])
    a = after.select(F.col(key).alias("_key"), *[F.col(c).alias(f"after_{c}") for c in fields])
    gate = sanitize.structure_gate({c: F.col(f"before_{c}") for c in fields}, {c: F.col(f"after_{c}") for c in fields})
    return b.join(a, "_key", "left").withColumn("mismatch", gate).drop("_key")


#: The fields of a page that are stored.
DOCUMENT_FIELDS = ("url", "status", "pageLoadMethod", "title", "search", "ref", "redirects", "preDoublefetch", "lang", "lastUpdatedAt")


def documents(pages: DataFrame, now: Column, activity: str = "activity") -> DataFrame:
    """The stored fields that a table of pages has, and an `aggregator`: when it was seen, written, and how active."""
    kept = [c for c in DOCUMENT_FIELDS if c in pages.columns]
    score = F.coalesce(F.col(activity).cast("double"), F.lit(0.0)) if activity in pages.columns else F.lit(0.0)
    seen = F.struct(now.alias("firstSeenAt"), now.alias("lastSeenAt"), F.lit(None).cast("timestamp_ntz").alias("lastWrittenAt"), score.alias("activity"))
    return pages.select(*kept, seen.alias("aggregator"))


def descriptions(tabs: DataFrame, reliable_load: bool = True) -> DataFrame:
    """The public view of tabs: what is empty is null, pages that ask not to be indexed are private, only the active tab has an activity.

    Input: status, title, url, visibility, window_id, updated_at, active, previous_url, load_method, language, noindex,
    redirects, search (a struct) and activity.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    hidden = F.coalesce(F.col("noindex"), F.lit(False))
    return tabs.select(
        "status",
        "title",
        "url",
        F.when(hidden, "private").otherwise(F.col("visibility")).alias("visibility"),
        "window_id",
        "updated_at",
        "active",
        given("previous_url").alias("ref"),
        (given("load_method") if reliable_load else F.lit(None).cast("string")).alias("load_method"),
        F.col("language").alias("lang"),
        "redirects",
        "search",
        F.when(F.col("active") & F.col("url").isNotNull(), F.col("activity")).alias("activity"),
    )


def active_time(events: DataFrame, page: str, order: list[str], ts: str, is_active: Column) -> DataFrame:
    """Seconds for which each page was active: from each event that makes it active to the next that does not; an open end does not count."""
    w = Window.partitionBy(page).orderBy(*order)
    span = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    e = events.withColumn("_span", F.when(is_active, span))
    open_end = Window.partitionBy(page).orderBy(*[F.desc(c) for c in order])
    # Spans of a last run of active events never ended.
    e = e.withColumn("_ended", F.max((~F.coalesce(is_active, F.lit(False))).cast("int")).over(open_end))
    return e.groupBy(page).agg(F.coalesce(F.sum(F.when(F.col("_ended") == 1, F.col("_span"))), F.lit(0.0)).alias("active_seconds"))


def store_violations(pages: DataFrame, persisted: DataFrame, expirations: DataFrame, most: int = 2000) -> DataFrame:
    """(client, violation): page stores whose three sets of URLs differ, that expire out of order, or hold too many.

    Pages and persisted: client, url; expirations: client, url, position, created_at.
    """
    parts = [df.select("client", "url").distinct().select("client", "url", F.lit(i).alias("part")) for i, df in enumerate((pages, persisted, expirations))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("client", "url").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    per = every.groupBy("client").agg(F.min("n").alias("least"), F.count_if(F.col("part") == 0).alias("pages"))
    apart = per.where("least < 3").select("client", F.lit("keys differ").alias("violation"))
    many = per.where(F.col("pages") > most).select("client", F.lit("too many pages").alias("violation"))
    w = Window.partitionBy("client").orderBy("position")
    wrong = expirations.withColumn("_before", F.lag("created_at").over(w)).where("_before > created_at").select("client", F.lit("not ordered").alias("violation")).distinct()
    return apart.unionByName(many).unionByName(wrong)
