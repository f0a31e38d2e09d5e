"""Queries of joins and states over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtel.functions import times
from webtel.operators import filters, openers, rotation
from webtel.plans.registry import _K, NOW, _events, query
from webtel.session import Stages
from webtel.sources.tables import table
from webtel.streaming import flows, jobs, lifecycle

_DAY = 86_400_000


def _unit(key: str) -> str:
    """SQL of a number in [0, 1) from the hash of a key."""
    return f"(('0x' || substr(md5('0:' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, (epoch_ms(ts) // 60000) * 60000 AS tick, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS i FROM t),
r AS (SELECT user_id, 0::BIGINT AS i, tick AS s, (tick + floor({_unit("user_id")} * {_DAY + 1}))::BIGINT AS e, 0::BIGINT AS no, 0::BIGINT AS n, NULL::STRUCT(p BIGINT, s BIGINT, e BIGINT, x BIGINT, v BIGINT) AS d FROM o WHERE i = 1
  UNION ALL
  SELECT r.user_id, o.i,
    CASE WHEN tick < e THEN s WHEN no = 0 THEN tick ELSE e + (tick - e) // {_DAY} * {_DAY} END,
    CASE WHEN tick < e THEN e WHEN no = 0 THEN tick + {_DAY} ELSE (e + (tick - e) // {_DAY} * {_DAY} + {round(0.9 * _DAY)} + floor({_unit("r.user_id || ':' || (no + 1)")} * {round(1.1 * _DAY) - round(0.9 * _DAY) + 1}))::BIGINT END,
    CASE WHEN tick < e THEN no ELSE no + 1 END,
    CASE WHEN tick < e THEN CASE WHEN no = 0 THEN 0 ELSE r.n + o.n END ELSE o.n END,
    CASE WHEN tick >= e AND no > 0 THEN {{'p': no, 's': s, 'e': e, 'x': tick, 'v': r.n}} END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, d.p AS period, d.s AS start_ms, d.e AS end_ms, d.x AS ended_ms, d.v AS visits FROM r WHERE d IS NOT NULL
""")
def client_rotations(spark, d):
    e = _events(spark, d).select("user_id", times.millis(F.col("ts")).alias("at_ms"))
    return rotation.rotations(e, "user_id", "at_ms", _DAY)


@query(f"""
WITH v AS (SELECT user_id::VARCHAR || '-' || {_K} AS v, event_type, epoch_ms(ts) // 604800000 * 604800000 AS g FROM events),
m AS (SELECT unnest([0, 1, 2]) AS part, unnest([1009, 1013, 1019]) AS m),
h AS (SELECT DISTINCT v, ('0x' || substr(md5(v), 1, 13))::BIGINT AS h FROM v),
f AS (SELECT DISTINCT g, part, h % m AS bit FROM v JOIN h USING (v), m WHERE event_type = 'click' AND g <= epoch_ms({NOW}) + 2 * 604800000 AND g >= epoch_ms({NOW}) - 2 * 604800000),
l AS (SELECT * FROM f WHERE g IN (SELECT DISTINCT g FROM f ORDER BY g DESC LIMIT 2)),
c AS (SELECT v FROM h, m JOIN l ON l.part = m.part WHERE l.bit = h % m GROUP BY v, g HAVING count(*) = 3)
SELECT v AS value, v IN (SELECT v FROM c) AS might_contain FROM h
""")
def rotating_filters(spark, d):
    """Which values two generations of a week each may hold, of those that clicks have added."""
    sizes, week = [1009, 1013, 1019], 7 * _DAY
    e = _events(spark, d).select("event_type", F.concat_ws("-", "user_id", "k").alias("value"), filters.generation(times.millis(F.col("ts")), week).alias("generation"))
    f = filters.added(e.where("event_type = 'click'"), "value", "generation", sizes)
    held = filters.rotated(f, times.millis(F.expr(NOW)), week)
    return filters.might_contain(e.select("value").distinct(), "value", held, sizes)


@query(f"""
WITH s AS (SELECT user_id AS tab, ts, event_id, CASE WHEN {_K}::INT % 4 = 0 THEN 'about:blank' ELSE 'https://h' || ({_K}::INT % 3) || '.test/' END AS url,
  CASE WHEN {_K}::INT % 2 = 0 THEN ['https://r.test/', 'https://h' || ({_K}::INT % 3) || '.test/'] END AS red FROM events),
o AS (SELECT event_id AS id, user_id AS tab, (user_id * 7 + 3) % 20 AS opener, ts FROM events WHERE event_type = 'signup'),
a AS (SELECT o.*, s.url AS opener_url, s.red FROM o ASOF LEFT JOIN s ON o.opener = s.tab AND o.ts >= s.ts),
f AS (SELECT a.*, n.url AS url FROM a ASOF LEFT JOIN (SELECT * FROM s WHERE url <> 'about:blank') n ON a.tab = n.tab AND a.ts <= n.ts)
SELECT id, opener, CASE WHEN opener_url LIKE 'http%' THEN opener_url END AS opener_url, url, CASE WHEN len(red) > 0 AND red[-1] = url THEN array_to_string(red, ' ') END AS redirects FROM f
""")
def opened_pages(spark, d):
    e, k = _events(spark, d), F.col("k").cast("int")
    host = F.concat(F.lit("https://h"), k % 3, F.lit(".test/"))
    s = e.select(F.col("user_id").alias("tab"), "ts", F.col("event_id").alias("order"), F.when(k % 4 == 0, openers.BLANK).otherwise(host).alias("url"), F.when(k % 2 == 0, F.array(F.lit("https://r.test/"), host)).alias("redirects"))
    o = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("tab"), ((F.col("user_id") * 7 + 3) % 20).alias("opener"), "ts")
    found = openers.confirmed(openers.opener_states(o, s, ["url", "redirects"]), s)
    return found.select("id", "opener", "opener_url", "url", F.array_join("redirects", " ").alias("redirects"))


# --- jobs -------------------------------------------------------------------------------------------------------

_JOB_NOW = 820_454_400_000  # 1996-01-01
_LIMITS = jobs.Limits(per_type=400, total=1_500)
_ORDERS = f"""
WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS type, epoch_ms(o_orderdate)::BIGINT AS born, floor(o_totalprice)::BIGINT AS p FROM orders),
s AS (SELECT id, type, CASE WHEN p % 4 = 0 THEN 'retryable' WHEN p % 4 = 1 THEN 'ready' ELSE 'waiting' END AS state, born AS created, born + 200 * 86400000::BIGINT AS expire, CASE WHEN p % 4 = 0 THEN (p % 2 + 1)::INT END AS attempts, CASE WHEN p % 4 = 0 THEN born END AS queued FROM o WHERE born < {_JOB_NOW}),
r AS (SELECT *, CASE WHEN expire <= {_JOB_NOW} THEN 'expired' ELSE state END AS st FROM s),
x AS (SELECT r.*, CASE WHEN st <> 'expired' AND id % 5 = 0 THEN CASE id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'recoverable' ELSE 'permanent' END END AS outcome, CASE WHEN attempts IS NULL THEN 2 ELSE attempts - 1 END AS l FROM r),
y AS (SELECT id, type, CASE WHEN outcome IS NULL THEN st WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'recoverable' AND l > 0 THEN 'retryable' ELSE 'failed' END AS st, created, expire,
  CASE WHEN outcome = 'recoverable' AND l > 0 THEN l ELSE attempts END AS attempts, CASE WHEN outcome = 'recoverable' AND l > 0 THEN {_JOB_NOW} ELSE queued END AS queued FROM x),
d AS (SELECT type, count(*) AS ok FROM y WHERE st = 'done' GROUP BY type),
w AS (SELECT y.*, CASE WHEN st = 'retryable' THEN row_number() OVER (PARTITION BY y.type, st ORDER BY queued, created, id::VARCHAR) END AS turn FROM y),
z AS (SELECT id, w.type, CASE WHEN turn <= ok THEN 'ready' ELSE st END AS st, created, attempts, queued FROM w LEFT JOIN d ON d.type = w.type)
"""


def _order_jobs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), times.millis(F.col("o_orderdate")).alias("at"), F.floor("o_totalprice").alias("p"))
    return o.withColumn("job_id", F.col("id").cast("string"))


def _old_jobs(o):
    retry = F.col("p") % 4 == 0
    old = o.where(F.col("at") < _JOB_NOW)
    return old.select("job_id", "type", F.when(retry, "retryable").when(F.col("p") % 4 == 1, "ready").otherwise("waiting").alias("state"), F.col("at").alias("created_ms"), F.col("at").alias("ready_ms"), (F.col("at") + 200 * jobs.DAY_MS).alias("expire_ms"), F.when(retry, F.col("p") % 2 + 1).cast("int").alias("attempts_left"), F.when(retry, F.col("at")).alias("queued_ms"))


def _job_outcomes(o):
    i = F.col("id")
    return o.where(i % 5 == 0).select("job_id", F.when(i % 3 == 0, "ok").when(i % 3 == 1, "recoverable").otherwise("permanent").alias("outcome"))


@query(_ORDERS + "SELECT id::VARCHAR AS job_id, type, st AS state, attempts AS attempts_left FROM z")
def job_outcomes(spark, d):
    """States of jobs after their runs: retries, failures, and those that successes put back."""
    o = _order_jobs(spark, d)
    now = F.lit(_JOB_NOW)
    return jobs.after_outcomes(jobs.restored(_old_jobs(o), now), _job_outcomes(o), now, _LIMITS).select("job_id", "type", "state", "attempts_left")


@query(_ORDERS + f""",
n AS (SELECT id, type, p, CASE WHEN id % 7 = 0 THEN 'bad config' WHEN id % 11 = 0 THEN 'expired' ELSE 'waiting' END AS st FROM o WHERE born >= {_JOB_NOW}),
c AS (SELECT type, count(*) FILTER (st IN ('waiting', 'ready', 'retryable')) AS alive, count(*) FILTER (st = 'retryable') AS retry FROM z GROUP BY type),
i AS (SELECT n.*, row_number() OVER (PARTITION BY n.type ORDER BY id) AS i FROM n WHERE st = 'waiting'),
l AS (SELECT i.id, i.type, greatest(i - greatest({_LIMITS.per_type} - coalesce(alive, 0), 0), 0) AS over, coalesce(retry, 0) AS retry FROM i LEFT JOIN c ON c.type = i.type),
g AS (SELECT type, max(over) AS gone FROM l WHERE over <= retry GROUP BY type),
q AS (SELECT z.id, z.type, CASE WHEN z.st = 'retryable' AND row_number() OVER (PARTITION BY z.type, z.st ORDER BY queued, created, z.id::VARCHAR) <= gone THEN 'dropped' ELSE z.st END AS st FROM z LEFT JOIN g ON g.type = z.type),
u AS (SELECT count(*) AS used FROM q WHERE st IN ('waiting', 'ready', 'retryable')),
f AS (SELECT l.id, l.type, CASE WHEN used + row_number() OVER (ORDER BY l.id) > {_LIMITS.total} THEN 'global limit' ELSE 'waiting' END AS st FROM l, u WHERE over <= retry)
SELECT id::VARCHAR AS job_id, type, st AS state FROM q UNION ALL SELECT id::VARCHAR, type, st FROM n WHERE st <> 'waiting' UNION ALL SELECT id::VARCHAR, type, 'local limit' FROM l WHERE over > retry UNION ALL SELECT id::VARCHAR, type, st FROM f
""")
def job_versions(spark, d):
    """A whole step: expiry, outcomes, and new jobs up to the limits of their type and of all."""
    o, i, none = _order_jobs(spark, d), F.col("id"), F.lit(None).cast("long")
    fresh = o.where(F.col("at") >= _JOB_NOW)
    fresh = fresh.select("job_id", "type", i.alias("order"), none.alias("ready_ms"), F.when(i % 7 == 0, F.lit(-1)).otherwise(i % 1000).cast("long").alias("min_ms"), none.alias("max_ms"), F.when(i % 11 == 0, F.lit(_JOB_NOW)).alias("expire_ms"), none.alias("ttl_ms"))
    return jobs.next_version(_old_jobs(o), fresh, _job_outcomes(o), F.lit(_JOB_NOW), _LIMITS).select("job_id", "type", "state")


# --- streams ----------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE e AS (SELECT (user_id % 5)::VARCHAR AS client, event_id, epoch_ms(ts) - CASE WHEN {_K}::INT % 10 = 0 THEN {_K}::INT * 10000 ELSE 0 END AS x FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY event_id) AS i FROM e),
r AS (SELECT client, event_id, i, x // 524288 AS bucket, 0::BIGINT AS epoch, false AS reset FROM o WHERE i = 1
  UNION ALL SELECT o.client, o.event_id, o.i, CASE WHEN bucket * 524288 - x >= 120000 OR x >= (bucket + 1) * 524288 THEN x // 524288 ELSE bucket END,
    epoch + (bucket * 524288 - x >= 120000)::BIGINT, bucket * 524288 - x >= 120000 FROM r JOIN o ON o.client = r.client AND o.i = r.i + 1)
SELECT client, event_id AS "order", bucket, epoch, reset FROM r
""")
def stream_clock_jumps(spark, d):
    """Activity buckets of clients whose clocks run back now and then."""
    stages = Stages(spark, "clock-jumps")
    e = flows.events_stream(spark, f"{d}/events.parquet", files=None)
    k = F.get_json_object("props", "$.k").cast("int")
    back = F.make_dt_interval(secs=F.when(k % 10 == 0, k * 10).otherwise(0).cast("decimal(18,6)"))
    e = e.select((F.col("user_id") % 5).alias("client"), "event_id", (F.col("ts") - back).alias("at"))
    with flows.keyed_state(spark):
        flows.run_to_end(lifecycle.guarded_buckets(e, "client", "event_id", "at"), f"{stages.root}/out", f"{stages.root}/checkpoint")
    return spark.read.schema(lifecycle.BUCKETED).parquet(f"{stages.root}/out")


def tab_events(e):
    """Events as those of tabs: views commit documents, sign-ups close the tab, errors hide it, purchases show it, clicks are requests."""
    kind = F.when(F.col("event_type") == "view", "commit").when(F.col("event_type") == "signup", "gone").when(F.col("event_type") == "error", "inactive").when(F.col("event_type") == "purchase", "active").otherwise("request")
    doc = F.get_json_object("props", "$.k").cast("int") % 4
    return e.select((F.col("user_id") % 5).alias("tab"), "ts", F.col("event_id").alias("order"), kind.alias("kind"), doc.cast("string").alias("doc"))


@query()
def stream_page_lifecycles(spark, d):
    stages = Stages(spark, "lifecycles")
    out = lifecycle.page_lifecycles(tab_events(flows.events_stream(spark, f"{d}/events.parquet", files=None)))
    with flows.keyed_state(spark):
        flows.run_to_end(out, f"{stages.root}/out", f"{stages.root}/checkpoint")
    return spark.read.schema(lifecycle.ENDED).parquet(f"{stages.root}/out")


@query("""
WITH d AS (SELECT event_id, ts, 'https://' || user_id || '.test/' AS page_url FROM events WHERE event_type = 'view'),
r AS (SELECT event_id AS request_id, event_id - 1 AS document_id, event_id - 2 AS parent, ts FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
j AS (SELECT r.*, a.page_url AS own, b.page_url AS up FROM r LEFT JOIN d a ON a.event_id = document_id AND r.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR LEFT JOIN d b ON b.event_id = parent AND r.ts BETWEEN b.ts AND b.ts + INTERVAL 1 HOUR)
SELECT request_id, CASE WHEN own IS NOT NULL THEN 'document' WHEN up IS NOT NULL THEN 'parent' END AS by, coalesce(own, up) AS page_url FROM j
""")
def stream_attribution(spark, d):
    """Requests with the page of their document or its parent; those of the last day may still be waiting and are left out."""
    stages = Stages(spark, "attribution")
    e = lambda kind: flows.events_stream(spark, f"{d}/events.parquet", files=None).where(F.col("event_type") == kind)
    docs = e("view").select(F.col("event_id").alias("document_id"), "ts", F.concat(F.lit("https://"), "user_id", F.lit(".test/")).alias("page_url"))
    req = e("click").select(F.col("event_id").alias("request_id"), (F.col("event_id") - 1).alias("document_id"), (F.col("event_id") - 2).alias("parent_document_id"), "ts")
    out = lifecycle.attributed(req, docs)
    flows.run_to_end(out, f"{stages.root}/out", f"{stages.root}/checkpoint")
    last = _events(spark, d).agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("last"))
    got = spark.read.schema(out.schema).parquet(f"{stages.root}/out")
    return got.join(F.broadcast(last), F.col("ts") < F.col("last")).select("request_id", "by", "page_url")  # one row
