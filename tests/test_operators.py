"""Stateful operators on small hand-made tables, and streams against batches."""

import datetime as dt

from pyspark.sql import functions as F

from webtel.functions import sanitize
from webtel.operators import messages, pages, popularity, requests
from webtel.session import Stages
from webtel.sources import tables
from webtel.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_attribution(spark):
    r = spark.createDataFrame([(1, "d1", None), (2, "d9", "d1"), (3, "d9", None), (4, "d2", None)], "id int, document_id string, parent_document_id string")
    d = spark.createDataFrame([("d1", 10, "active"), ("d2", 20, "prerender")], "document_id string, page_id int, lifecycle string")
    assert sorted((x.id, x.page_id) for x in requests.attribute(r, d).collect()) == [(1, 10), (2, 10)]


def test_response_stats_count_missing_length_as_one(spark):
    df = spark.createDataFrame([(200, None, "a=b"), (404, 50, "a=bcdef"), (200, 1, "a=b; SameSite=None")], "s int, n int, c string")
    got = [{x.stat: x.n for x in r.x} for r in df.select(requests.response_stats(F.col("s"), F.col("n"), F.col("c")).alias("x")).collect()]
    assert got == [{"resp_ob": 1, "content_length": 1, "status_200": 1}, {"resp_ob": 1, "content_length": 50, "status_404": 1, "set_cookie_set": 1}, {"resp_ob": 1, "content_length": 1, "status_200": 1, "set_cookie_set": 1, "set_cookie_samesite_none": 1}]


def test_depth_two_stays_on_its_host(spark):
    rows = [(1, 0, True, "s"), (1, 1, False, "a"), (1, 2, False, "a"), (1, 3, False, "a"), (2, 0, True, "s"), (2, 1, False, "a"), (2, 2, False, "b")]
    df = spark.createDataFrame(rows, "tab int, i int, s boolean, h string")
    got = pages.search_depth(df, "tab", ["i"], F.col("s"), F.col("h")).orderBy("tab", "i").collect()
    assert [r.depth for r in got] == [0, 1, 2, None, 0, 1, None]


def test_redirect_chain_is_capped(spark):
    rows = [(1, i, True, f"u{i}") for i in range(10)] + [(1, 10, False, "end"), (1, 11, False, "next")]
    got = pages.redirect_chains(spark.createDataFrame(rows, "tab int, i int, r boolean, u string"), "tab", ["i"], F.col("r"), "u").orderBy("i").collect()
    assert got[0].redirects == [f"u{i}" for i in range(8)] + ["..."] and got[1].redirects == []


def test_structure_gate(spark):
    b = spark.createDataFrame([("u1", "Title one", False), ("u2", "Title", False), ("u3", "Other thing", False)], "url string, title string, noindex boolean")
    a = spark.createDataFrame([("u1", "title  ONE", False), ("u2", "Title", True), ("u3", "Changed", False)], "url string, title string, noindex boolean")
    assert sorted((r.before_url, r.mismatch) for r in pages.before_and_after(b, a).collect()) == [("u1", None), ("u2", "noindex after"), ("u3", "title")]


def test_cookie_trust_limits(spark):
    v = spark.createDataFrame([("a", "b", at(0), False), ("a", "c", at(0), True)], "source string, target string, ts timestamp_ntz, used boolean")
    c = spark.createDataFrame([(1, "a", "b", at(120)), (2, "a", "b", at(121)), (3, "a", "c", at(750)), (4, "a", "c", at(751)), (5, "x", "b", at(1))], "id int, source string, target string, ts timestamp_ntz")
    assert sorted(r.id for r in requests.visits_trusted(c, v).collect()) == [1, 3]


def test_weighted_sample_recovers_the_distribution(spark):
    counted = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "key string, n int")
    picks = spark.range(1000).select(F.col("id").alias("position"))
    got = {r.key: r["count"] for r in popularity.weighted_picks(counted, picks).groupBy("key").count().collect()}
    assert got == {"a": 900, "b": 90, "c": 10}


def test_noise_mean(spark):
    r = spark.range(20000).select(popularity.with_noise(F.lit(1.0), 0.25, 1.75, 3).alias("x")).agg(F.avg("x"), F.min("x"), F.max("x")).first()
    assert abs(r[0] - 1) < 0.02 and r[1] >= 0.25 and r[2] <= 1.75


def test_retries(spark):
    j = spark.createDataFrame([(1, "ready", 0), (2, "ready", 0), (3, "ready", 2), (4, "waiting", 0)], "job_id int, state string, attempts int")
    o = spark.createDataFrame([(1, "ok"), (2, "recoverable"), (3, "recoverable")], "job_id int, outcome string")
    assert sorted((r.job_id, r.state) for r in messages.after_run(j, o).collect()) == [(1, "done"), (2, "retryable"), (3, "failed"), (4, "waiting")]


def test_seen_hashes_expire(spark):
    d = spark.createDataFrame([("a",), ("b",)], "h string")
    seen = spark.createDataFrame([("a", at(10)), ("b", at(1))], "h string, expire_at timestamp_ntz")
    now = F.lit(at(5)).cast("timestamp_ntz")
    assert [r.h for r in messages.not_seen(d, seen, "h", now).collect()] == ["b"]


def test_fetch_classes(spark):
    df = spark.createDataFrame([(200, "text/html", 10), (503, None, 0), (404, None, 0), (200, "image/png", 5), (200, "text/html", 20 << 20), (None, None, None)], "s int, t string, n int")
    got = [r.c for r in df.select(tables.fetch_class(F.col("s"), F.col("t"), F.col("n")).alias("c")).collect()]
    assert got == ["ok", "retry", "permanent error", "content type", "too large", "network error"]


def test_expiring_set_stream(spark):
    stages = Stages(spark, "test-set")
    rows = [(i, at(s), 1, "view", 1.0, None) for i, s in enumerate([0, 50, 100, 150, 260])]
    spark.createDataFrame(rows, tables.EVENTS).coalesce(1).write.parquet(f"{stages.root}/in")
    out = flows.add_if_absent(flows.events_stream(spark, f"{stages.root}/in"), "user_id", 100_000)
    flows.run_to_end(out, f"{stages.root}/out", f"{stages.root}/cp")
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted(r.at_ms // 1000 - base for r in spark.read.parquet(f"{stages.root}/out").collect()) == [0, 100, 260]


def test_streams_of_many_files(spark):
    """Late files do not change the registered queries of whole tables."""
    from webtel.plans.catalog import QUERIES

    root = Stages(spark, "test-late").root
    rows = [(i, T0 + dt.timedelta(days=i), i % 7, "view", 1.0, None) for i in range(240)]
    spark.createDataFrame(rows, tables.EVENTS).repartitionByRange(60, F.desc("ts")).write.parquet(f"{root}/events.parquet")
    assert QUERIES["stream_sessions"](spark, root).agg(F.sum("n")).first()[0] == 240
    assert QUERIES["stream_dedup"](spark, root).count() == 240


def test_sessions_close_once(spark):
    """Sessions are appended as the watermark passes them, and equal those of a loop over all events; the open ones close at the end."""
    stages = Stages(spark, "test-sessions")
    rows = [(i, T0 + dt.timedelta(minutes=m), u, "view", 1.0, None) for i, (m, u) in enumerate([(0, 1), (4, 1), (5, 2), (30, 1), (31, None), (200, 2), (206, 2), (400, 1), (401, None)])]
    for row in rows:
        spark.createDataFrame([row], tables.EVENTS).coalesce(1).write.mode("append").parquet(f"{stages.root}/in")
    want, last = [], {}
    for _, ts, u, *_ in rows:
        if u in last and ts - last[u][2] < dt.timedelta(minutes=10):
            last[u][2:] = [ts, last[u][3] + 1]
        else:
            last[u] = [u, ts, ts, 1]
            want.append(last[u])
    got = flows.sessions_to_end(spark, f"{stages.root}/in", "user_id", "10 minutes", stages.root, files=1)
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    found = got.select("user_id", naive("start"), naive("end"), "n").collect()
    assert sorted(map(str, map(list, found))) == sorted(map(str, want))
    again = spark.createDataFrame([], tables.EVENTS)
    again.write.parquet(f"{stages.root}/none")
    assert flows.sessions_to_end(spark, f"{stages.root}/none", "user_id", "10 minutes", f"{stages.root}/other").count() == 0


def test_gates(spark):
    from webtel.operators import gates

    ua = ["Mozilla/5.0 Firefox/153.0", "Mozilla/5.0 Chrome/105.0 Safari/537", "Mozilla/5.0 Version/18 Safari/605", "curl/8", None]
    df = spark.createDataFrame([(x,) for x in ua], "a string")
    got = df.select(gates.browser(F.col("a"))["name"].alias("n"), gates.supported(F.col("a"), {"Firefox": 150, "Chrome": 106}).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [("Firefox", True), ("Chrome", False), ("Safari", False), (None, False), (None, False)]
    lines = spark.createDataFrame([(["a=1; Path=/", "b=x=y", "a=2", "junk"],)], "l array<string>")
    assert lines.select(gates.captured(F.col("l")).alias("m")).first().m == {"a": "2", "b": "x=y"}
    t = spark.createDataFrame([("Caf� society news", "Café society news"), ("A long enough headline here", "A long enough headline, here!"), ("x", "y"), (None, "a")], "a string, b string")
    assert [r.c for r in t.select(sanitize.titles_match(F.col("b"), F.col("a")).alias("c")).collect()] == [True, True, False, False]
    h = spark.createDataFrame([("printer.local", None), ("shop.com", True), ("shop.com", None), ("10.0.0.1", None)], "h string, l boolean")
    assert [r.p for r in h.select(gates.private_host(F.col("h"), F.col("l")).alias("p")).collect()] == [True, True, False, True]
    u = spark.createDataFrame([("https://a.test/login", True, True, True), ("https://a.test/login", True, False, None), ("https://a.test/x", None, None, None)], "u string, c boolean, i boolean, r boolean")
    assert [r.x for r in u.select(gates.tiered_url(*map(F.col, "ucir")).alias("x")).collect()] == ["https://a.test/login", None, "https://a.test/x"]
    rules = {"e": ("https://e.test/click", ["id"])}
    a = spark.createDataFrame([("https://shop.test/p", "red shoes", ["https://e.test/click?id=1"]), ("https://shop.test/p", "q", ["https://o.test/"])], "l string, q string, r array<string>")
    assert [r.x and tuple(r.x) for r in a.select(gates.ad_landing(F.col("l"), F.col("q"), F.col("r"), rules).alias("x")).collect()] == [("e", "red shoes", "e.test", "shop.test"), None]
    m = spark.createDataFrame([("old", at(0)), ("new", at(86400 * 200))], "value string, ts timestamp_ntz")
    assert [r.value for r in gates.rotating_members(m, F.lit(at(86400 * 220))).collect()] == ["new"]
