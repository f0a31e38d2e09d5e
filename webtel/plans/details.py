"""Queries of single decisions and small functions: tokens, pages, templates, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtel.functions import classify, nested, text, times, urls
from webtel.operators import gates, pages, popularity, requests
from webtel.plans.registry import _K, NOW, _events, query
from webtel.sources.tables import table

#: A token of every kind, by event: short, an identifier, one that stands in the page's URL, encoded ones, a number, an address, a time.
_KINDS = ("'a' || k", "substr(md5(k), 1, 12)", "substr(md5(k), 1, 14)", "'%41%42'", "'x%20' || substr(md5(k), 1, 9)", "'12345' || k", "'10.0.0.' || k", "'17040672' || lpad(k, 5, '0')")
_TOKEN = "CASE CAST(k AS INT) % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_KINDS)) + " END"
_MIXED = "(length(%s) >= 6 AND regexp_matches(%s, '[0-9]') AND regexp_matches(%s, '[a-f]'))"
_IS_ID = lambda c: "(CASE WHEN length({0}) < 6 THEN false WHEN length({0}) BETWEEN 7 AND 15 AND regexp_full_match({0}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}(:[0-9]+)?') THEN false WHEN length({0}) < 13 AND length(regexp_replace({0}, '[^0-9]', '', 'g')) / length({0}) > 0.8 THEN true WHEN regexp_full_match({0}, '[0-9]{{13}}') AND {0}::BIGINT BETWEEN 1265000000000 AND 1706659200000 + 157680000000 THEN false ELSE regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[a-f]') END)".format(c)


def _candidate(c):
    return classify.token_candidate(c, c.rlike("[0-9]") & c.rlike("[a-f]"), times.millis(F.expr(NOW)))


def _sent(spark, d):
    e = _events(spark, d).withColumn("token", F.expr(_TOKEN))
    page = F.concat(F.lit("https://s"), F.col("user_id") % 20, F.lit(".test/"), F.when(F.col("k").cast("int") % 8 == 2, F.col("token")).otherwise(""))
    return e.select("event_id", (F.col("user_id") % 20).alias("site"), page.alias("page_url"), F.col("event_type").alias("tracker"), (F.col("event_type") != "view").alias("is_tracker"), (F.col("user_id") % 9 == 0).alias("is_private"), (F.col("user_id") % 3).cast("string").alias("key"), "token", "ts", F.col("event_id").alias("order"))


_SENT = f"""
WITH t AS (SELECT event_id, user_id, event_type AS tracker, ts, {_K} AS k FROM events),
s AS (SELECT event_id, user_id % 20 AS site, 'https://s' || (user_id % 20) || '.test/' || CASE WHEN CAST(k AS INT) % 8 = 2 THEN {_TOKEN} ELSE '' END AS page_url, tracker, user_id % 9 = 0 AS private, (user_id % 3)::VARCHAR AS key, {_TOKEN} AS token, ts FROM t)
"""


@query(_SENT + f"SELECT DISTINCT token, {_IS_ID('token')} AS candidate FROM s")
def token_candidates(spark, d):
    return _sent(spark, d).select("token").distinct().select("token", _candidate(F.col("token")).alias("candidate"))


@query(_SENT + f""",
e AS (SELECT *, CASE WHEN tracker = 'view' THEN 'no_tracker' WHEN NOT {_IS_ID('token')} THEN 'no_check' WHEN contains(page_url, token) THEN 'source_url' WHEN NOT {_IS_ID('url_decode(token)')} THEN 'no_check_decoded'
  WHEN tracker = 'click' AND key = '1' THEN 'safe_key' WHEN tracker = 'error' AND token = substr(md5('1'), 1, 12) THEN 'safe_token' END AS early FROM s),
f AS (SELECT token, site, min((ts, event_id)) AS first FROM e WHERE early IS NULL AND NOT private GROUP BY ALL),
n AS (SELECT token, first FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY first, site) AS i FROM f) WHERE i = 3)
SELECT event_id, coalesce(early, CASE WHEN (ts, event_id) >= first THEN 'threshold' ELSE 'new' END) AS status FROM e LEFT JOIN n ON n.token = e.token
""")
def token_statuses(spark, d):
    sent = _sent(spark, d)
    keys = sent.where("tracker = 'click' AND key = '1'").select("tracker", "key")
    tokens = sent.where("tracker = 'error' AND token = substr(md5('1'), 1, 12)").select("tracker", "token")
    return requests.token_statuses(sent, keys, tokens, _candidate, 3).select("event_id", "status")


@query("SELECT page_id FROM pages WHERE floor(('0x' || substr(md5('0:' || page_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * 5)::BIGINT = 0")
def local_sample(spark, d):
    return popularity.bernoulli(table(spark, d, "pages").select("page_id"), 5, "page_id")


@query("""
WITH p AS (SELECT page_id, url, 'Title ' || (page_id % 9) AS title, page_id % 10 = 0 AS noindex FROM pages),
a AS (SELECT page_id, CASE WHEN page_id % 5 = 1 THEN url || '&x=1' ELSE split_part(url, '#', 1) END AS url, CASE WHEN page_id % 4 = 1 THEN 'Other' WHEN page_id % 4 = 3 THEN NULL ELSE upper(title) END AS title, page_id % 7 = 0 AS noindex FROM p WHERE page_id % 6 > 0)
SELECT p.page_id, CASE WHEN p.noindex THEN 'noindex before' WHEN coalesce(a.noindex, false) THEN 'noindex after' WHEN a.title IS NULL THEN 'no title' WHEN lower(a.title) <> lower(p.title) THEN 'title' WHEN split_part(p.url, '#', 1) <> split_part(a.url, '#', 1) THEN 'url' END AS mismatch FROM p LEFT JOIN a USING (page_id)
""")
def stored_and_fetched(spark, d):
    """Stored pages against their anonymous copies; pages without a copy have no title after."""
    i, u = F.col("page_id"), F.col("url")
    p = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("Title "), i % 9).alias("title"), (i % 10 == 0).alias("noindex"))
    a = p.where(i % 6 > 0).select("page_id", F.when(i % 5 == 1, F.concat(u, F.lit("&x=1"))).otherwise(urls.strip_fragment(u)).alias("url"), F.when(i % 4 == 1, "Other").when(i % 4 != 3, F.upper("title")).alias("title"), (i % 7 == 0).alias("noindex"))
    found = pages.before_and_after(p.withColumn("key", i), a.withColumn("key", i), "key")
    ids = p.select(F.col("url").alias("before_url"), "page_id", F.col("title").alias("before_title"), F.col("noindex").alias("before_noindex"))
    return found.join(ids, ["before_url", "before_title", "before_noindex"]).select("page_id", "mismatch").distinct()


@query("""
WITH p AS (SELECT page_id, url, page_id % 5 = 0 AS c, page_id % 3 = 0 AS i, CASE WHEN page_id % 2 = 0 THEN true END AS r FROM pages),
s AS (SELECT *, regexp_matches(url, '[?#]') AS long FROM p)
SELECT page_id, c AND i AND coalesce(r, false) AS unchecked, CASE WHEN c AND i AND coalesce(r, false) THEN url END AS url FROM s
""")
def tiered_urls(spark, d):
    """URLs that need no check, since they are canonical, indexed and asked to be."""
    i = F.col("page_id")
    c, x, r = i % 5 == 0, i % 3 == 0, F.when(i % 2 == 0, True)
    all_three = c & x & F.coalesce(r, F.lit(False))
    p = table(spark, d, "pages").withColumn("tiered", gates.tiered_url(F.col("url"), c, x, r))
    return p.select("page_id", all_three.alias("unchecked"), F.when(all_three, F.col("tiered")).alias("url"))


@query("""
WITH e AS (SELECT event_id, 'https://shop' || (user_id % 9) || '.test/p?x=1' AS landing, 'red shoes ' || user_id AS query, CASE event_type WHEN 'click' THEN ['https://ads.test/click?id=' || user_id || '&t=1', 'https://o.test/'] WHEN 'view' THEN ['https://ads.test/click?id=1'] WHEN 'error' THEN ['https://other.test/aclk?a=&b=2'] ELSE [] END AS r FROM events)
SELECT event_id, CASE WHEN r[1] LIKE 'https://ads.test/click%' AND r[1] LIKE '%t=%' THEN 'one' ELSE 'two' END AS engine, query, split_part(r[1], '/', 3) AS "from", split_part(landing, '/', 3) AS "to" FROM e WHERE (r[1] LIKE 'https://ads.test/click%' AND r[1] LIKE '%t=%') OR r[1] LIKE 'https://other.test/aclk%'
""")
def ad_landings(spark, d):
    """Landings by the first hop of their redirects: engines by a prefix and the parameters that it must have."""
    e, u = _events(spark, d), F.col("user_id")
    one = F.array(F.concat(F.lit("https://ads.test/click?id="), u, F.lit("&t=1")), F.lit("https://o.test/"))
    red = F.when(F.col("event_type") == "click", one).when(F.col("event_type") == "view", F.array(F.lit("https://ads.test/click?id=1"))).when(F.col("event_type") == "error", F.array(F.lit("https://other.test/aclk?a=&b=2"))).otherwise(F.array().cast("array<string>"))
    rules = {"one": ("https://ads.test/click", ["id", "t"]), "two": ("https://other.test/aclk", ["a", "b"])}
    landed = gates.ad_landing(F.concat(F.lit("https://shop"), u % 9, F.lit(".test/p?x=1")), F.concat(F.lit("red shoes "), u), red, rules)
    return e.select("event_id", landed.alias("l")).where("l is not null").select("event_id", "l.*")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 'https://' || event_type || '.test/?q=' || CASE WHEN user_id % 3 = 0 THEN k WHEN user_id % 3 = 1 THEN event_type ELSE '' END || '&u=' || user_id || '&n=' AS filled FROM e
""")
def filled_templates(spark, d):
    """Placeholders with alternatives: the first value that is not empty; nothing if there is none."""
    e = _events(spark, d)
    m3 = F.col("user_id") % 3
    values = F.create_map(F.lit("cookie:a"), F.when(m3 == 0, F.col("k")).otherwise(""), F.lit("type"), F.when(m3 < 2, F.col("event_type")).otherwise(""), F.lit("user"), F.col("user_id").cast("string"), F.lit("host"), F.col("event_type"))
    return e.select("event_id", text.fill_template(F.lit("https://{{host}}.test/?q={{cookie:a||type}}&u={{ user }}&n={{nothing||none}}"), values).alias("filled"))


@query("""
SELECT event_id, array_to_string(list_sort(list_filter(CASE event_type WHEN 'click' THEN ['a', 'b'] WHEN 'view' THEN ['b', 'c'] ELSE ['a'] END, lambda x: x = 'a' OR (x = 'b' AND user_id % 2 = 0))), ',') AS names FROM events
""")
def requested_cookies(spark, d):
    """Names that templates ask for, as far as the client may send them."""
    t = F.when(F.col("event_type") == "click", F.array(F.lit("{{cookie:b||cookie:a}}"), F.lit("{{cookie:a}} {{q:z}}"))).when(F.col("event_type") == "view", F.array(F.lit("{{cookie:c||x}}-{{cookie:b}}"))).otherwise(F.array(F.lit("x{{cookie:a}}")))
    allowed = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return _events(spark, d).select("event_id", F.array_join(text.requested_names(t, "cookie:", allowed), ",").alias("names"))


@query("""
WITH p AS (SELECT page_id, 'https://a.test/x?gclid=old&q=' || page_id || '&sid=1#f' AS url, page_id::VARCHAR AS key FROM pages),
v AS (SELECT *, sha256(key || chr(10) || 'gclid') AS a, sha256(key || chr(10) || 'sid') AS b FROM p)
SELECT page_id, 'https://a.test/x?gclid=' || substr(a, 1, (6 + ('0x' || substr(a, 57, 8))::BIGINT % 9)::INT) || '&q=' || page_id || '&sid=' || substr(b, 1, (6 + ('0x' || substr(b, 57, 8))::BIGINT % 9)::INT) || '#f' AS url FROM v
""")
def randomised_urls(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", urls.randomised_params(F.concat(F.lit("https://a.test/x?gclid=old&q="), i, F.lit("&sid=1#f")), ["gclid", "sid", "none"], i.cast("string")).alias("url"))


@query(f"""
WITH c AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS n, list(CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE {_K} END ORDER BY ts, event_id) AS v, list(event_id ORDER BY ts, event_id) AS i FROM events GROUP BY user_id),
r AS (SELECT user_id, unnest(n) AS name, unnest(v) AS value, unnest(i) AS id FROM c)
SELECT user_id, id, name, value FROM r WHERE value <> ''
""")
def zipped_records(spark, d):
    """Parallel arrays of each user as records; those without a value go."""
    e = _events(spark, d).withColumn("v", F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 > 1, F.col("k")))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "v"))).alias("l"))
    of = lambda c: F.transform("l", lambda x: x[c])
    records = nested.zip_records({"name": of("event_type"), "value": of("v"), "id": of("event_id")}, ["value"])
    return lists.select("user_id", F.explode(records).alias("r")).select("user_id", "r.id", "r.name", "r.value")


@query(f"""
WITH m AS (SELECT user_id, event_type || '-' || {_K} AS key, count(DISTINCT event_id % 2) AS n, min(event_id % 2)::VARCHAR AS value FROM events GROUP BY ALL)
SELECT user_id, key, value FROM m WHERE n = 1
""")
def merged_metadata(spark, d):
    """Maps of metadata merged: keys whose values differ are dropped."""
    e = _events(spark, d).withColumn("m", F.create_map(F.concat_ws("-", "event_type", "k"), (F.col("event_id") % 2).cast("string")))
    return e.groupBy("user_id").agg(F.collect_list("m").alias("m")).select("user_id", F.explode(nested.first_wins(F.col("m"))).alias("key", "value"))


@query("""
SELECT page_id, '{"lang":"en",' || CASE WHEN page_id % 2 = 0 THEN '"title":"Page ' || page_id || '",' ELSE '' END || '"url":"https://a.test/' || page_id || '"}' AS message FROM pages
""")
def page_messages(spark, d):
    """Messages of pages with sorted keys; what is null is left out."""
    i = F.col("page_id")
    message = gates.page_message(F.concat(F.lit("https://a.test/"), i), {"title": F.when(i % 2 == 0, F.concat(F.lit("Page "), i)), "ref": F.lit(None).cast("string"), "lang": F.lit("en")})
    return table(spark, d, "pages").select("page_id", message.alias("message"))


@query("""
WITH p AS (SELECT event_id, user_id, ts, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events),
v AS (SELECT event_id AS page, 'https://h' || k || '.test/a' || (k % 7) || '/b?c' AS url, event_id - event_id % 2 AS doc, epoch_ms(ts) + 1000 AS destroyed FROM p WHERE event_type <> 'error' AND k % 10 <> 3 AND user_id % 6 > 0),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY destroyed, page) AS i FROM v) WHERE i = 1),
s AS (SELECT event_id AS page, 't' || (k % 3) || '.test' AS tp, k % 5 + 1 AS n FROM p WHERE k % 4 > 0)
SELECT o.page, substr(md5(split_part(url, '/', 3)), 1, 16) AS hostname, substr(md5('/' || split_part(url, '/', 4)), 1, 16) AS path, 1000::BIGINT AS t, tp || ':' || n AS tps FROM o JOIN s USING (page)
""")
def page_loads(spark, d):
    """Messages of complete, public pages, once for each document."""
    e = _events(spark, d).withColumn("k", F.col("k").cast("int"))
    at = times.millis(F.col("ts"))
    p = e.select(
        F.col("event_id").alias("page"), F.concat(F.lit("https://h"), "k", F.lit(".test/a"), F.col("k") % 7, F.lit("/b?c")).alias("url"), (F.col("event_id") - F.col("event_id") % 2).alias("document_id"),
        F.when(F.col("event_type") == "error", "committed").otherwise("complete").alias("state"), (F.col("k") % 10 == 3).alias("is_private"), (F.col("user_id") % 6 == 0).alias("is_private_server"),
        at.alias("created_ms"), (at + 1000).alias("destroyed_ms"), F.lit(5).alias("active_ms"), F.lit(1).alias("counter"), F.lit(None).cast("string").alias("adblocker"),
    )
    stats = e.where("k % 4 > 0").select(F.col("event_id").alias("page"), F.concat(F.lit("t"), F.col("k") % 3, F.lit(".test")).alias("tp_domain"), F.lit("c").alias("stat"), (F.col("k") % 5 + 1).alias("n"))
    out = requests.page_loads(stats, p, "page")
    return out.select("page", "hostname", "path", "t", F.explode("tps").alias("tp", "stats")).select("page", "hostname", "path", "t", F.concat_ws(":", "tp", F.col("stats")["c"]).alias("tps"))
