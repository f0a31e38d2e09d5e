"""Requests of pages to third parties: attribution, statistics, tokens and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.functions import urls
from webtel.functions.nested import truncated_hash
from webtel.operators.numbering import running_total


def attribute(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests with the page of their document, or else of its parent; without one, or prerendered, they go."""
    own = documents.select(F.col("document_id"), F.col("page_id").alias("_own"), F.col("lifecycle").alias("_life"))
    parent = documents.select(F.col("document_id").alias("parent_document_id"), F.col("page_id").alias("_parent"))
    j = requests.join(own, "document_id", "left").join(parent, "parent_document_id", "left")
    j = j.withColumn("page_id", F.coalesce("_own", "_parent")).where("page_id is not null")
    return j.where(F.coalesce(F.col("_life"), F.lit("active")) != "prerender").drop("_own", "_parent", "_life")


def request_facts(requests: DataFrame, page_url: str = "page_url", url: str = "url", suffixes: tuple[str, ...] = urls.SUFFIXES) -> DataFrame:
    """Parties of each request; requests without two valid URLs go."""
    first, other = F.col(page_url), F.col(url)
    r = requests.where(urls.is_page(first) & urls.is_page(other))
    r = r.withColumn("first_party", urls.registrable_domain(urls.part(first, "host"), suffixes))
    r = r.withColumn("third_party", urls.registrable_domain(urls.part(other, "host"), suffixes))
    return r.withColumn("tp_domain", urls.truncate_domain(urls.part(other, "host"), suffixes=suffixes))


def third_party_only(facts: DataFrame) -> DataFrame:
    return facts.where(urls.is_third_party(F.col("first_party"), F.col("third_party")))


#: Numbers of request types in the statistics.
TYPE_NUMBERS = {
    "other": 1, "script": 2, "image": 3, "stylesheet": 4, "object": 5, "main_frame": 6, "sub_frame": 7, "xbl": 9, "ping": 10,
    "xmlhttprequest": 11, "object_subrequest": 12, "xml_dtd": 13, "font": 14, "media": 15, "websocket": 16, "csp_report": 17,
    "xslt": 18, "beacon": 19, "imageset": 21, "web_manifest": 22,
}


def stat_names(url: Column, kind: Column | None = None, method: Column | None = None, placeholder: str | None = None) -> Column:
    """The counters that a request adds one to; schemes but for http and https are other, types without a number unknown."""
    has = lambda part: F.length(urls.part(url, part)) > 0
    scheme = urls.part(url, "scheme")
    stats = [
        F.lit("c"),
        F.when(has("search"), "has_qs"),
        F.when(urls.part(url, "path").contains(";"), "has_ps"),
        F.when(has("fragment"), "has_fragment"),
        F.concat(F.lit("scheme_"), F.when(scheme.isin("http", "https"), scheme).otherwise("other")),
    ]
    if kind is not None:
        numbers = F.create_map(*[F.lit(x) for k, n in TYPE_NUMBERS.items() for x in (k, str(n))])
        stats.append(F.concat(F.lit("type_"), F.coalesce(F.try_element_at(numbers, kind), F.lit("unknown"))))
    if method is not None:
        stats.append(F.when(method == "POST", "has_post"))
    if placeholder is not None:
        stats.append(F.when(F.contains(url, F.lit(placeholder)), "hasPlaceHolder"))
    return F.array_compact(F.array(*stats))


def header_stats(url: Column, page_url: Column, referrer: Column, cookie: Column) -> Column:
    """The counters of a request's headers: referrers and URLs that tell the page, and cookies of more than five characters."""
    holds = lambda p: F.contains(url, p) | F.contains(url, urls.encode_component(p))
    host, path = urls.part(page_url, "host"), urls.part(page_url, "path")
    return F.array_compact(
        F.array(
            F.when(F.contains(referrer, page_url), "referer_leak_header"),
            F.when(holds(host), "referer_leak_site"),
            F.when(holds(host) & holds(path), "referer_leak_path"),
            F.when(F.length(cookie) > 5, "cookie_set"),
        )
    )


def response_stats(status: Column, length: Column, set_cookie: Column) -> Column:
    """(stat, amount) of a response; a missing or zero length counts as one, cookies of more than five characters are set."""
    pair = lambda s, n: F.struct(s.alias("stat"), n.cast("long").alias("n"))
    return F.array_compact(
        F.array(
            pair(F.lit("resp_ob"), F.lit(1)),
            pair(F.lit("content_length"), F.when(length > 0, length).otherwise(1)),
            F.when(status.isNotNull(), pair(F.concat(F.lit("status_"), status.cast("string")), F.lit(1))),
            F.when(F.length(set_cookie) > 5, pair(F.lit("set_cookie_set"), F.lit(1))),
            F.when((F.length(set_cookie) > 5) & F.contains(F.lower(set_cookie), F.lit("samesite=none")), pair(F.lit("set_cookie_samesite_none"), F.lit(1))),
        )
    )


def page_stats(facts: DataFrame, page: str, kind: str | None = None) -> DataFrame:
    """(page, tp_domain, stat, n): all counters of a page's third parties."""
    names = stat_names(F.col("url"), F.col(kind) if kind else None)
    return facts.select(page, "tp_domain", F.explode(names).alias("stat")).groupBy(page, "tp_domain", "stat").agg(F.count(F.lit(1)).alias("n"))


def page_events(stats: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """One row per page with third parties: hashed host and path, and a map of maps of counters."""
    per_domain = stats.groupBy(page, "tp_domain").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stat", "n")))).alias("stats"))
    per_page = per_domain.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("tp_domain", "stats"))).alias("tps"))
    url = F.col("url")
    head = pages.select(page, truncated_hash(urls.part(url, "host")).alias("hostname"), truncated_hash(urls.part(url, "path")).alias("path"), urls.part(url, "scheme").alias("scheme"))
    return head.join(per_page, page)


#: Fields of a page's message that no longer hold anything.
EMPTY_FIELDS = {"c": 1, "ra": 0, "placeHolder": False, "tsv": "", "tsv_id": False}


def page_loads(stats: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Whole messages of pages with third parties, once for each document: as page_events, with times, counters and empty fields.

    Pages: `page`, url, document_id, state, is_private, is_private_server,
    created_ms, destroyed_ms, active_ms, counter, adblocker (null if unknown).
    Only complete http pages that are not private; of several pages with one
    document the first to end counts. The path is its first part, hashed.
    """
    url = F.col("url")
    public = (F.col("state") == "complete") & ~F.coalesce(F.col("is_private"), F.lit(False)) & ~F.coalesce(F.col("is_private_server"), F.lit(False)) & F.startswith(urls.part(url, "scheme"), F.lit("http"))
    once = pages.where(public & F.col("document_id").isNotNull()).groupBy("document_id").agg(F.min(F.struct("destroyed_ms", page, *[c for c in pages.columns if c not in ("destroyed_ms", page, "document_id")])).alias("_p")).select("document_id", "_p.*")
    per_domain = stats.groupBy(page, "tp_domain").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stat", "n")))).alias("stats"))
    tps = per_domain.groupBy(page).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tp_domain", F.map_entries("stats").alias("e"))))).alias("_tps"))
    first_part = F.concat(F.lit("/"), F.split_part(F.substring(urls.part(url, "path"), 2, 1 << 30), F.lit("/"), F.lit(1)))
    nothing = F.array().cast("array<string>")
    return once.join(tps, page).select(
        page,
        truncated_hash(urls.part(url, "host")).alias("hostname"),
        truncated_hash(first_part).alias("path"),
        urls.part(url, "scheme").alias("scheme"),
        *[F.lit(v).alias(k) for k, v in EMPTY_FIELDS.items()],
        F.round(F.col("destroyed_ms") - F.col("created_ms")).cast("long").alias("t"),
        F.col("active_ms").alias("active"),
        "counter",
        "adblocker",
        nothing.alias("redirects"),
        nothing.alias("redirectsPlaceHolder"),
        F.transform_values("_tps", lambda _, e: F.map_from_entries(e)).alias("tps"),
    )


def token_stats(tokens: DataFrame) -> DataFrame:
    """Per token: distinct sites and trackers, whether always safe, uses, first use. Input: token, site, tracker, safe, ts."""
    return tokens.groupBy("token").agg(
        F.countDistinct("site").alias("sites"),
        F.countDistinct("tracker").alias("trackers"),
        F.bool_and("safe").alias("safe"),
        F.count(F.lit(1)).alias("uses"),
        F.min("ts").alias("created"),
    )


def sendable(stats: DataFrame, now: Column, last_day: Column | None = None) -> DataFrame:
    """Tokens of several sites, or used again after an hour; not those sent today."""
    due = (F.col("sites") > 1) | ((F.col("uses") > 1) & (F.col("created") < now - F.expr("INTERVAL 1 HOUR")))
    fresh = F.lit(True) if last_day is None else F.coalesce(last_day != F.date_format(now, "yyyyMMdd"), F.lit(True))
    return stats.where(due & fresh)


def key_stats(tokens: DataFrame) -> DataFrame:
    """Per tracker, key, site and token: uses, and the last verdict on safety (by time, then order)."""
    last = F.max_by("safe", F.struct("ts", "order")).alias("safe")
    return tokens.groupBy("tracker", "key", "site", "token").agg(F.count(F.lit(1)).alias("uses"), last)


def key_messages(keys: DataFrame, most_tokens: int = 512) -> DataFrame:
    """Tokens of a site in messages of at most so many, unsafe ones apart for each tracker and key; none is left out."""
    apart = F.when(~F.col("safe"), F.concat_ws(":", "tracker", "key")).otherwise("")
    numbered = running_total(keys.withColumn("apart", apart), ["site", "apart"], [F.asc(c) for c in ("token", "tracker", "key")], 1, "_n")
    k = numbered.withColumn("part", F.floor((F.col("_n") - 1) / most_tokens))
    return k.groupBy("site", "apart", "part").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.count(F.lit(1)).alias("n")).drop("part")


def safe_keys(tokens: DataFrame, now: Column, days: int = 7, more_than: int = 4) -> DataFrame:
    """Tracker keys that took many values lately: they identify nobody."""
    recent = tokens.where(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("tracker", "key").agg(F.countDistinct("token").alias("n_values")).where(F.col("n_values") > more_than)


def blocked_tokens(tokens: DataFrame, sites: int = 2, days: int = 7) -> DataFrame:
    """Tokens that a tracker saw on several sites, and the day their block ends."""
    seen = tokens.groupBy("token").agg(F.countDistinct("site").alias("n_sites"), F.max("ts").alias("last"))
    end = F.date_format(F.col("last") + F.expr(f"INTERVAL {days} DAYS"), "yyyyMMdd")
    return seen.where(F.col("n_sites") >= sites).select("token", "n_sites", end.alias("expires"))


def token_verdicts(tokens: DataFrame, safe: DataFrame, blocked: DataFrame, candidate: Column) -> DataFrame:
    """Ordered decision on each token: no_check, safe_key, new, or threshold (seen on too many sites)."""
    s = safe.select("tracker", "key", F.lit(True).alias("_safe"))
    b = blocked.select("token", F.lit(True).alias("_blocked"))
    j = tokens.join(s, ["tracker", "key"], "left").join(b, "token", "left")
    verdict = F.when(~candidate, "no_check").when(F.col("_safe"), "safe_key").when(F.col("_blocked"), "threshold").otherwise("new")
    return j.withColumn("verdict", verdict).drop("_safe", "_blocked")


def token_statuses(tokens: DataFrame, safe_keys: DataFrame, safe_tokens: DataFrame, candidate: Callable[[Column], Column], sites: int = 2) -> DataFrame:
    """`tokens` with `status`, the first of the ordered decisions that holds, as known at the time of the request.

    Tokens: site, page_url, tracker, is_tracker, is_private, key, token, ts,
    order; safe_keys: tracker, key; safe_tokens: tracker, token. Requests of
    others than trackers are `no_tracker`. Then: `no_check` (no identifier by
    `candidate`), `source_url` (it stands in the page's URL), `no_check_decoded`,
    `safe_key`, `safe_token`, and `threshold` once the token was seen on
    `sites` sites, this request counted unless it is private; else `new`.

    That moment is found for each token from the first request of each of
    its sites, of which only the first `sites` are kept before the shuffle.
    """
    k = safe_keys.select("tracker", "key").distinct().withColumn("_key", F.lit(True))
    t = safe_tokens.select("tracker", "token").distinct().withColumn("_token", F.lit(True))
    j = tokens.join(k, ["tracker", "key"], "left").join(t, ["tracker", "token"], "left")
    decoded = F.coalesce(urls.decode_component(F.col("token")), F.col("token"))
    early = (
        F.when(~F.coalesce(F.col("is_tracker"), F.lit(False)), "no_tracker")
        .when(~F.coalesce(candidate(F.col("token")), F.lit(False)), "no_check")
        .when(F.contains("page_url", "token"), "source_url")
        .when(~F.coalesce(candidate(decoded), F.lit(False)), "no_check_decoded")
        .when(F.col("_key"), "safe_key")
        .when(F.col("_token"), "safe_token")
    )
    j = j.withColumn("status", early).drop("_key", "_token").select(*tokens.columns, "status")
    counted = j.where(F.col("status").isNull() & ~F.coalesce(F.col("is_private"), F.lit(False)))
    firsts = counted.groupBy("token", "site").agg(F.min(F.struct("ts", "order")).alias("_first"))
    nth = Window.partitionBy("token").orderBy("_first", "site")
    reached = firsts.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= sites).where(F.col("_n") == sites).select(F.col("token").alias("_t"), F.col("_first").alias("_since"))
    late = j.join(reached, F.col("token") == F.col("_t"), "left")
    past = F.coalesce(F.struct("ts", "order") >= F.col("_since"), F.lit(False))
    return late.withColumn("status", F.coalesce("status", F.when(past, "threshold").otherwise("new"))).drop("_t", "_since")


def message_batches(rows: DataFrame, order: list[str], size: int = 10, partition: list[str] | None = None) -> DataFrame:
    """Rows numbered into batches of `size`, within a partition (a day, a site) if any is given."""
    numbered = running_total(rows, partition or [], [F.asc(c) for c in order], 1, "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def visits_trusted(cookies: DataFrame, visits: DataFrame, unused: str = "2 minutes", used: str = "12 minutes 30 seconds") -> DataFrame:
    """Cookie events whose host pair was visited shortly before: an interval join on the pair and a time range.

    Buckets of the longest span keep it an equality join: each visit is
    posted in its bucket and the next.
    """
    span = 750
    v = visits.select("source", "target", F.col("ts").alias("visit_ts"), "used")
    v = v.withColumn("slot", F.explode(F.array(F.floor(F.unix_seconds(F.col("visit_ts").cast("timestamp")) / span), F.floor(F.unix_seconds(F.col("visit_ts").cast("timestamp")) / span) + 1)))
    c = cookies.withColumn("slot", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / span))
    limit = F.when(F.col("used"), F.col("visit_ts") + F.expr(f"INTERVAL '{used}'")).otherwise(F.col("visit_ts") + F.expr(f"INTERVAL '{unused}'"))
    v = v.withColumn("visit_end", limit).select(*[F.col(c).alias(f"_{c}") for c in ("source", "target", "slot", "visit_ts", "visit_end")])
    same = [F.col(k) == F.col(f"_{k}") for k in ("source", "target", "slot")]
    hit = c.join(v, [*same, F.col("ts") >= F.col("_visit_ts"), F.col("ts") <= F.col("_visit_end")], "left_semi")
    return hit.select(*cookies.columns)
