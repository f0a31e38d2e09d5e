"""Decisions along the way of a message: cookies, log-ins, ads, publication, liveness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtel.functions import sanitize, text, urls
from webtel.functions.nested import canonical_json
from webtel.session import Stages


def cookie_gate(listed: Column, compatible: Column, trusted: Column, visited: Column, clicked: Column) -> Column:
    """The first reason to let a third-party cookie pass; null if there is none."""
    return F.when(listed, "listed").when(compatible, "compatibility").when(trusted, "trust").when(visited, "visit").when(clicked, "click")


def oauth_flows(requests: DataFrame, clicks: DataFrame, visits: DataFrame, click_s: int = 300, visit_s: int = 240) -> DataFrame:
    """Requests to log-in paths, after a click in the tab and a visit to the host not long ago.

    Requests: tab, host, path, ts; clicks: tab, ts; visits: host, ts. Both
    are joins by equality on time slots, each event posted in its own and
    the next.
    """
    r = requests.where(F.col("path").rlike("/oauth|/authorize")).withColumn("_id", F.monotonically_increasing_id())

    def recent(left: DataFrame, right: DataFrame, key: str, span: int) -> DataFrame:
        slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / span)
        posted = right.select(F.col(key).alias("_k"), F.col("ts").alias("_ts"), F.explode(F.array(slot, slot + 1)).alias("_slot"))
        hit = (F.col(key) == F.col("_k")) & (slot == F.col("_slot")) & (F.col("_ts") <= F.col("ts")) & (F.col("ts") <= F.col("_ts") + F.make_dt_interval(secs=F.lit(span)))
        return left.join(posted, hit, "left_semi")

    return recent(recent(r, clicks, "tab", click_s), visits, "host", visit_s).drop("_id")


def ad_redirect(url: Column, rules: dict[str, tuple[str, list[str]]]) -> Column:
    """The first engine whose ad links a URL is one of: a prefix and parameters that it must have."""
    fits = lambda prefix, names: reduce(lambda a, b: a & b, [urls.query_param(url, n).isNotNull() for n in names], F.startswith(url, F.lit(prefix)))
    return F.coalesce(*[F.when(fits(p, names), F.lit(k)) for k, (p, names) in rules.items()])


def ad_landing(landing: Column, query: Column, redirects: Column, rules: dict[str, tuple[str, list[str]]]) -> Column:
    """Struct (engine, query, from, to) of a landing that came through an ad link; hosts only, queries only if harmless."""
    first = F.get(redirects, F.lit(0))
    engine = ad_redirect(first, rules)
    safe = F.when(text.suspicious(query).isNull(), query)
    return F.when(engine.isNotNull(), F.struct(engine.alias("engine"), safe.alias("query"), urls.part(first, "host").alias("from"), urls.part(landing, "host").alias("to")))


def page_message(url: Column, optional: dict[str, Column]) -> Column:
    """JSON of a page: its URL and what there is of title, referrer, redirects, language, country, activity, query."""
    return canonical_json({"url": url, **optional})


def tiered_url(url: Column, canonical: Column, indexed: Column, requested: Column, is_id=None) -> Column:
    """Sanitised URL of a page: unchecked if canonical, indexed and asked to be; by default rules if one of these; else strictly.

    Null if the rules do not find it safe.
    """
    safe = lambda s: F.when(s["result"] == "safe", s["safe_url"])
    given = [F.coalesce(c, F.lit(False)) for c in (canonical, indexed, requested)]
    some = given[0] | given[1] | given[2]
    return F.when(given[0] & given[1] & given[2], url).when(some, safe(sanitize.sanitize(url))).otherwise(safe(sanitize.sanitize(url, is_id=is_id)))


def envelope(payload: dict[str, Column], action: str, ts: Column, agent: Column, country: Column) -> Column:
    """Telemetry message: type, agent, day, and the payload with hour and country."""
    body = F.struct(*[payload[k].alias(k) for k in sorted(payload)])
    inner = F.struct(country.alias("ctry"), body.alias("data"), F.date_format(ts, "yyyyMMdd").alias("day"), F.date_format(ts, "yyyyMMddHH").alias("ts"))
    return F.to_json(F.struct(F.lit(action).alias("action"), inner.alias("payload"), F.date_format(ts, "yyyyMMdd").alias("ts"), F.lit("telemetry").alias("type"), agent.alias("userAgent")))


def browser(agent: Column) -> Column:
    """Struct (name, version) of a user agent."""
    known = {"Firefox": r"Firefox/([0-9]+)", "Edge": r"Edg[A-Za-z]*/([0-9]+)", "Chrome": r"Chrom(?:e|ium)/([0-9]+)", "Safari": r"Version/([0-9]+).*Safari"}
    row = lambda k, p: F.when(agent.rlike(p), F.struct(F.lit(k).alias("name"), F.regexp_extract(agent, p, 1).cast("int").alias("version")))
    return F.coalesce(*[row(k, p) for k, p in known.items()])


def supported(agent: Column, least: dict[str, float]) -> Column:
    b = browser(agent)
    checks = [(b["name"] == k) & (b["version"] >= v) for k, v in least.items()]
    return F.coalesce(reduce(lambda a, c: a | c, checks), F.lit(False))


def alive_messages(clients: DataFrame, columns: list[str], k: int, client: str = "client", hour: str = "hour") -> DataFrame:
    """One row per client and hour; the configuration is blank unless k clients share it.

    The counts are written, so that the join has a plain exchange on both
    sides, where Spark can split a configuration that most clients have.
    """
    config = F.to_json(F.struct(*columns))
    c = clients.select(client, hour, *columns).distinct().withColumn("_config", config)
    shared = c.groupBy("_config").agg(F.countDistinct(client).alias("_n"))
    shared = Stages(clients.sparkSession, "alive").write(shared, "shared")
    j = c.join(shared, "_config").drop("_config")
    blank = {x: F.when(F.col("_n") >= k, F.col(x)).otherwise("") for x in columns}
    return j.withColumns(blank).select(client, hour, *columns).distinct()


def admitted_pages(pages: DataFrame, cooldowns: DataFrame, private: DataFrame, ts: str = "ts") -> DataFrame:
    """Pages whose URL hash is neither cooling down at that time nor known to be private."""
    p = pages.withColumn("_h", F.sha1("url"))
    cooling = cooldowns.select(F.col("hash").alias("_c"), F.col("until").alias("_until"))
    p = p.join(cooling, (F.col("_h") == F.col("_c")) & (F.col(ts) < F.col("_until")), "left_anti")
    return p.join(private.select(F.col("hash").alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def opened_from(tabs: DataFrame, openers: DataFrame) -> DataFrame:
    """Tabs with the URL of their opener, where the opener was still open and the tab's first URL confirms it."""
    o = openers.select(F.col("tab").alias("opener"), F.col("url").alias("opener_url"), F.col("target").alias("_target"))
    j = tabs.join(o, "opener", "left")
    ok = F.col("_target").isin("about:blank") | (F.col("_target") == F.col("url"))
    return j.withColumn("opener_url", F.when(ok, F.col("opener_url"))).drop("_target")


def learned_addresses(answers: DataFrame, now: Column, host: str = "host", ip: str = "ip", ts: str = "ts", order: str = "id", ttl: str = "24 hours") -> DataFrame:
    """The newest address of each host from the last day, and whether it is local."""
    live = answers.where(F.col(ts) > now - F.expr(f"INTERVAL {ttl}"))
    newest = live.groupBy(host).agg(F.max_by(ip, F.struct(ts, order)).alias(ip))
    return newest.withColumn("local", urls.is_local_ip(F.col(ip)))


#: Domain suffixes of hosts that are not public.
PRIVATE_SUFFIXES = ("local", "internal", "intranet", "private", "corp", "home", "lan", "mail", "localhost", "invalid", "test", "arpa", "onion", "alt")


def private_host(host: Column, known_local: Column, suffixes: tuple[str, ...] = PRIVATE_SUFFIXES) -> Column:
    """Host names of private networks: by suffix, by learned address, or an address itself; else public."""
    by_name = reduce(lambda a, s: a | (host == s) | F.endswith(host, F.lit("." + s)), suffixes, F.lit(False))
    return F.coalesce(by_name | known_local | urls.is_local_ip(host), F.lit(False))


def once_a_day(rows: DataFrame, keys: list[str], ts: str, order: str) -> DataFrame:
    """The first row of each key and UTC day."""
    w = Window.partitionBy(*keys, "_day").orderBy(ts, order)
    return rows.withColumn("_day", F.date_format(ts, "yyyyMMdd")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_day")


def delayed(rows: DataFrame, ts: str, low_s: float, high_s: float, seed: int | None = None, ttl: str = "5 days") -> DataFrame:
    """`ready_at` within a range of delays, at its middle without a seed, and `expire_at`."""
    wait = F.lit((low_s + high_s) / 2) if seed is None else F.lit(low_s) + F.rand(seed) * (high_s - low_s)
    ready = F.col(ts) + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))
    return rows.withColumn("ready_at", ready).withColumn("expire_at", F.col("ready_at") + F.expr(f"INTERVAL {ttl}"))


def captured(lines: Column) -> Column:
    """Map of k=v;... header lines: names up to the first equal sign, values up to the semicolon; the last wins."""
    pairs = F.filter(F.transform(lines, lambda s: F.regexp_extract(s, r"^\s*([^=;]+=[^;]*)", 1)), lambda s: s != "")
    names = F.array_distinct(F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1))))
    last = lambda n: F.regexp_replace(F.element_at(F.filter(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)) == n), -1), "^[^=]*=", "")
    return F.map_from_arrays(names, F.transform(names, last))


def runs(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Consecutive equal values as (value, n), in order of `run`."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    d = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return d.groupBy(*partition, "run", value).agg(F.count(F.lit(1)).alias("n"))


def rotating_members(added: DataFrame, now: Column, value: str = "value", ts: str = "ts", months: int = 3, generations: int = 2) -> DataFrame:
    """Values of the newest generations, each of some months: what a rotating filter still holds."""
    generation = F.floor(F.months_between(F.col(ts), F.lit("1970-01-01").cast("timestamp")) / months)
    newest = F.floor(F.months_between(now, F.lit("1970-01-01").cast("timestamp")) / months)
    return added.where(generation > newest - generations).select(value).distinct()


def fetch_request(rule: dict, url: str) -> dict:
    """What an anonymous fetch of a URL needs, by the optional settings of a rule; a fallback may have one of its own."""
    names = {"followRedirects": "redirect", "headers": "headers", "steps": "steps", "timeout": "timeout", "emptyHtml": "emptyHtml"}
    out = {"url": url}
    at = out
    while rule:
        for have, want in names.items():
            value = rule.get(have)
            if value or (have == "emptyHtml" and value is False):
                at[want] = "follow" if have == "followRedirects" else value
        rule = rule.get("onError")
        if rule is not None:
            nested: dict = {}
            at["onError"], at = nested, nested
    return out
