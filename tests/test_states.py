"""Joins and states over time against versions that walk through the rows one by one."""

import bisect
import collections
import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from webtel.functions import urls
from webtel.operators import filters, openers, popularity, requests, rotation, suffixes
from webtel.plans import states
from webtel.sources import tables
from webtel.streaming import flows, lifecycle

T0 = dt.datetime(2024, 1, 1)
MS0 = 1_704_067_200_000


def when(ms):
    return T0 + dt.timedelta(milliseconds=ms)


# --- public suffixes


def domain_brute(host, rules):
    host = host.lower().removesuffix(".")
    labels = host.split(".")
    best = None
    for rule in rules:
        exception, parts = rule.startswith("!"), rule.removeprefix("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(parts, labels[len(labels) - len(parts) :], strict=True)):
            found = (exception, len(parts) - exception)
            best = max(best, found) if best else found
    k = best[1] if best else 1
    return ".".join(labels[-k:]), ".".join(labels[-k - 1 :]) if len(labels) > k else None


def test_suffixes(spark, tmp_path):
    text = "// a list\n\ncom\nCO.UK // with a note\nuk\n*.ck\n!www.ck\n  *.a.com\n// ===BEGIN PRIVATE DOMAINS===\nblog.net\n*.shop.org\r\n"
    (tmp_path / "list.dat").write_text(text)
    rules = suffixes.suffix_rules(spark, str(tmp_path / "list.dat"))
    assert sorted(map(tuple, rules.collect())) == sorted([("com", False), ("co.uk", False), ("uk", False), ("*.ck", False), ("!www.ck", False), ("*.a.com", False), ("blog.net", True), ("*.shop.org", True)])
    rnd = random.Random(1)
    hosts = [".".join(rnd.choice(["com", "co", "uk", "ck", "www", "a", "net", "blog", "shop", "org", "x"]) for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    hosts += ["Example.COM", "example.com.", "a" * 60 + ".com", "bücher.com"]
    df = spark.createDataFrame([(h, "x") for h in [*hosts, hosts[0]]], "h string, suffix_ string")
    for private in (True, False):
        used = [r.rule for r in rules.collect() if private or not r.private]
        got = suffixes.with_domain(df, "h", rules, private).collect()
        assert len(got) == len(hosts) + 1
        for r in got:
            assert (r.suffix, r.domain) == domain_brute(r.h, used), r.h
    odd = suffixes.with_domain(spark.createDataFrame([(None,), ("",), ("10.0.0.1",), ("[::1]",)], "h string"), "h", rules).collect()
    assert all(r.suffix is None and r.domain is None for r in odd)
    assert suffixes.with_domain(df, "h", rules.limit(0)).where("domain is null and h like '%.%'").count() == 0
    assert suffixes.with_domain(df.limit(0), "h", rules).count() == 0


# --- rotation


def unit(key):
    return int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)


def rotations_brute(rows, period, tick=60_000):
    out = []
    for client in {c for c, _ in rows}:
        ticks = collections.Counter(t // tick * tick for c, t in rows if c == client)
        first = min(ticks)
        start, end, no, n = first, first + int(unit(client) * (period + 1)), 0, 0
        for t in sorted(ticks):
            if t < end:
                n += ticks[t] if no else 0
            elif no == 0:
                start, end, no, n = t, t + period, 1, ticks[t]
            else:
                out.append((client, no, start, end, t, n))
                start = end + (t - end) // period * period
                low, high = round(0.9 * period), round(1.1 * period)
                no, n = no + 1, ticks[t]
                end = start + low + int(unit(f"{client}:{no}") * (high - low + 1))
    return sorted(out)


def test_rotations(spark):
    rnd = random.Random(3)
    rows = [(f"c{rnd.randint(0, 4)}", MS0 + rnd.randint(0, 40 * 86_400_000)) for _ in range(600)]
    rows += [("hot", MS0 + rnd.randint(0, 9 * 86_400_000)) for _ in range(3000)] + [("once", MS0)]
    df = spark.createDataFrame([*rows, (None, MS0), ("c0", None)], "client string, at long").repartition(3)
    got = rotation.rotations(df, "client", "at", 86_400_000)
    assert sorted(map(tuple, got.collect())) == rotations_brute(rows, 86_400_000)
    counted = rotation.counted_in(df, got, "client", "at").groupBy("client", "period").count()
    assert {(r.client, r.period): r["count"] for r in counted.collect()} == {(c, p): n for c, p, _, _, _, n in rotations_brute(rows, 86_400_000)}
    assert rotation.rotations(df.limit(0), "client", "at", 1000).count() == 0


# --- filters


def test_filters(spark):
    rnd = random.Random(5)
    sizes, every = [37, 41, 43], 100
    rows = [(rnd.randint(0, 600), f"v{rnd.randint(0, 99)}") for _ in range(60)] + [(9_000, "ahead"), (550, None)]
    df = spark.createDataFrame(rows, "at long, v string").withColumn("g", filters.generation(F.col("at"), every))
    half = [filters.added(df.where(F.col("at") % 2 == i), "v", "g", sizes) for i in (0, 1)]
    held = filters.rotated(filters.merged(*half), F.lit(580), every)
    kept = sorted({at // every * every for at, _ in rows if 380 <= at // every * every <= 780})[-2:]
    places = {g: {(i, int(hashlib.md5(v.encode()).hexdigest()[:13], 16) % m) for at, v in rows if v and at // every * every == g for i, m in enumerate(sizes)} for g in kept}
    probes = [f"v{i}" for i in range(300)] + [None, "ahead"]
    got = {r.v: r.might_contain for r in filters.might_contain(spark.createDataFrame([(v,) for v in probes], "v string"), "v", held, sizes).collect()}
    for v in probes[:-2]:
        h = int(hashlib.md5(v.encode()).hexdigest()[:13], 16)
        assert got[v] == any(all((i, h % m) in p for i, m in enumerate(sizes)) for p in places.values()), v
    assert got[None] is False and all(got[v] for at, v in rows if v and at // every * every in kept)
    with pytest.raises(ValueError):
        filters.added(df, "v", "g", [10, 15])


# --- openers


def test_openers(spark):
    rnd = random.Random(6)
    pages = ["https://a.test/", "https://b.test/", "about:blank", "file:///x", None]
    s = [(rnd.randint(0, 5), when(rnd.randint(0, 50) * 1000), i, rnd.choice(pages), rnd.choice([None, [], ["https://r.test/", "https://a.test/"], ["https://b.test/"]])) for i in range(200)]
    o = [(i, rnd.randint(0, 5), rnd.choice([0, 1, 2, 7, None]), when(rnd.randint(0, 60) * 1000)) for i in range(100)]
    states_df = spark.createDataFrame([*s, (None, when(0), 900, "https://n.test/", None)], "tab int, ts timestamp_ntz, order int, url string, redirects array<string>").repartition(3)
    found = openers.opener_states(spark.createDataFrame(o, "id int, tab int, opener int, ts timestamp_ntz"), states_df, ["url", "redirects"])
    got = {r.id: r for r in openers.confirmed(found, states_df).collect()}
    assert len(got) == 100
    for i, tab, opener, ts in o:
        before = [x for x in s if x[0] == opener and x[1] <= ts]
        state = max(before, key=lambda x: x[1:3]) if before else (None,) * 5
        later = [x for x in s if x[0] == tab and x[1] >= ts and x[3] not in (None, "about:blank")]
        url = min(later, key=lambda x: x[1:3])[3] if later else None
        red = state[4] if state[4] and state[4][-1] == url else None
        opened = state[3] if state[3] and state[3].startswith("http") else None
        assert (got[i].opener_url, got[i].url, got[i].redirects) == (opened, url, red), i


# --- streams


def pages_brute(rows, watermark):
    out = []
    for tab in {r[0] for r in rows}:
        pages, doc, active = {}, None, False

        def end(d, at, reason):
            p = pages.pop(d)
            out.append((tab, d, p["start"], at, reason, p["requests"], p["active"] + (at - p["since"] if p["since"] is not None else 0)))

        def expire(until):
            ends = [min((p["start"] + 3_600_000, "hour"), (p["left"] + 600_000 if p["left"] is not None else float("inf"), "unseen")) + (d,) for d, p in pages.items()]
            for at, reason, d in sorted(ends):
                if at < until:
                    end(d, at, reason)

        for _, at, _, kind, d in sorted((r for r in rows if r[0] == tab and r[1] <= watermark), key=lambda r: r[1:3]):
            expire(at)
            if kind == "commit" and d:
                if doc in pages and doc != d:
                    pages[doc]["left"] = at
                doc = d
                if d in pages:
                    pages[d]["left"] = None
                else:
                    pages[d] = {"start": at, "left": None, "requests": 0, "since": at if active else None, "active": 0}
            elif kind == "request" and d in pages:
                pages[d]["requests"] += 1
            elif kind in ("active", "inactive"):
                active = kind == "active"
                for p in pages.values():
                    if active and p["since"] is None:
                        p["since"] = at
                    elif not active and p["since"] is not None:
                        p["active"] += at - p["since"]
                        p["since"] = None
            elif kind == "gone":
                for x in list(pages):
                    end(x, at, "gone")
                doc = None
        expire(watermark + 1)
    return sorted(out)


@pytest.mark.parametrize("files", [1, 6])
def test_lifecycles(spark, tmp_path, files):
    """One batch and many batches give the same pages."""
    rnd = random.Random(8)
    rows, t = [], 0
    for i in range(500):
        t += rnd.choice([0, 1_000, 20_000, 200_000, 700_000]) if i % 40 else 4_000_000
        rows.append((str(rnd.randint(0, 2)), MS0 + t, i, rnd.choice(["commit", "commit", "request", "request", "request", "active", "inactive", "gone"]), rnd.choice(["a", "b", "c", None])))
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame([(tab, when(at - MS0), o, kind, d) for tab, at, o, kind, d in part], "tab string, ts timestamp, order long, kind string, doc string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os
    import time

    names = sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
    for i, p in enumerate(names):
        os.utime(p, (time.time() - 1000 + i, time.time() - 1000 + i))
    stream = spark.readStream.schema("tab string, ts timestamp, order long, kind string, doc string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    with flows.keyed_state(spark):
        flows.run_to_end(lifecycle.page_lifecycles(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted(map(tuple, spark.read.schema(lifecycle.ENDED).parquet(str(tmp_path / "out")).collect()))
    want = pages_brute(rows, max(r[1] for r in rows) - 3_600_000)
    assert got == want and {r[4] for r in want} == {"hour", "unseen", "gone"} and len(want) > 40


def test_registered_lifecycles(spark):
    from tests.conftest import DATA

    root = f"{DATA}/sf0.001"
    e = states.tab_events(spark.read.parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    rows = [(str(r.tab), r.at, r.order, r.kind, r.doc) for r in e.withColumn("at", F.unix_millis("ts")).collect()]
    want = pages_brute(rows, max(r[1] for r in rows) - 120_000)
    assert sorted(map(tuple, states.stream_page_lifecycles(spark, root).collect())) == want and want


def test_clock_jumps_across_batches(spark, tmp_path):
    rnd = random.Random(9)
    rows, t = [], 10**9
    for i in range(300):
        t += rnd.choice([1_000, 100_000, 600_000])
        rows.append((rnd.choice("ab"), i, MS0 + t - rnd.choice([0, 0, 0, 60_000, 119_999, 120_000, 900_000])))
    for k in range(3):
        spark.createDataFrame([(c, o, when(at - MS0)) for c, o, at in rows[k * 100 : k * 100 + 100]], "c string, o long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c string, o long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with flows.keyed_state(spark):
        flows.run_to_end(lifecycle.guarded_buckets(stream, "c", "o", "ts"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = []
    for c in "ab":
        bucket, epoch = None, 0
        for _, o, at in (r for r in rows if r[0] == c):
            reset = False
            if bucket is not None and at < bucket * 524_288:
                reset = bucket * 524_288 - at >= 120_000
            if bucket is None or reset or at >= (bucket + 1) * 524_288:
                bucket = at // 524_288
            epoch += reset
            want.append((c, o, bucket, epoch, reset))
    assert sorted(map(tuple, spark.read.schema(lifecycle.BUCKETED).parquet(str(tmp_path / "out")).collect())) == sorted(want)
    assert any(r[4] for r in want)


# --- mended operators


def test_picks_meet_the_keys_of_their_slot_only(spark):
    rnd = random.Random(2)
    counts = {(g, k): rnd.choice([0, 1, 2, 50, 3000 if g == "x" else 1]) for g in "xyz" for k in range(30)}
    counted = spark.createDataFrame([(g, k, n) for (g, k), n in counts.items()], "g string, key int, n long").repartition(4)
    want = []
    for g in "xyz":
        ends, total = [], 0
        for k in range(30):
            total += counts[g, k]
            ends.append(total)
        want += [(g, p, bisect.bisect_right(ends, p)) for p in range(0, total, 7)]
    picks = spark.createDataFrame([(g, p) for g, p, _ in want], "g string, position long")
    got = popularity.weighted_picks(counted, picks, group="g")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_key_messages_of_many_tokens(spark):
    rows = [("t", "k", "hot", f"{i:05d}", True) for i in range(1300)] + [("t", "k", "hot", f"u{i}", False) for i in range(600)] + [("t", "k", "cold", "x", True)]
    got = requests.key_messages(spark.createDataFrame(rows, "tracker string, key string, site string, token string, safe boolean").repartition(3)).collect()
    assert sorted((r.site, r.apart, r.n) for r in got) == [("cold", "", 1), ("hot", "", 276), ("hot", "", 512), ("hot", "", 512), ("hot", "t:k", 88), ("hot", "t:k", 512)]
    assert sorted(t for r in got for t in r.tokens) == sorted(r[3] for r in rows)


def test_broken_json_is_null(spark):
    texts = ['{"a": 1}', "{}", '{"a":', "", None, "[1]", "nonsense", '{"a": "x"}', '{"a": 1, "a2": [1, {"b": null}]}', '{"a": 2}' + " " * 100]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tables.untrusted_json(F.col("t"), "a int", 100).alias("x")).orderBy("i").collect()
    assert [None if r.x is None else (r.x.a,) for r in got] == [(1,), (None,), None, None, None, None, None, (None,), (1,), None]


def test_decoding_rounds_are_enough(spark):
    deep = "a b"
    for _ in range(6):
        deep = "".join(f"%{ord(c):02X}" if c in "% " else c for c in deep)
    texts = {deep: "a b", "%2525252541": "A", "100%": "100%", "%41%2542%252543": "ABC", "x" * 1000: "x" * 1000, None: None}
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.decode_repeatedly(F.col("t")).alias("x")).collect()}
    assert got == texts

