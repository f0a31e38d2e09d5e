"""Job tables and title gates against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from webtel.functions import sanitize
from webtel.streaming import jobs

NOW, DAY = 1_700_000_000_000, jobs.DAY_MS


class Queue:
    """The same rules on a dictionary: job -> [type, state, created, ready, expire, left, queued]."""

    def __init__(self, limits):
        self.limits, self.jobs = limits, {}

    def oldest(self, kind):
        return sorted((j[6], j[2], k) for k, j in self.jobs.items() if j[0] == kind and j[1] == "retryable")

    def step(self, new, outcomes, now):
        self.jobs = {k: j for k, j in self.jobs.items() if j[1] in jobs.ALIVE}
        for j in self.jobs.values():
            j[1] = "purged" if j[2] >= now + DAY else "expired" if j[4] <= now else j[1]
        done = collections.Counter()
        for k, outcome in outcomes:
            j = self.jobs.get(k)
            if j is None or j[1] not in jobs.ALIVE:
                continue
            left = self.limits.retries if j[5] is None else j[5] - 1
            if outcome == "recoverable" and left > 0:
                j[1], j[3], j[5], j[6] = "retryable", now, left, now
            else:
                j[1] = "done" if outcome == "ok" else "failed"
                done[j[0]] += outcome == "ok"
        for kind, n in done.items():
            for _, _, k in self.oldest(kind)[:n]:
                self.jobs[k][1] = "ready"
        used = {kind: sum(j[0] == kind and j[1] in jobs.ALIVE for j in self.jobs.values()) for kind in "ab"}
        fits, known = [], set(self.jobs)
        for k, kind, order, low, expire in sorted(new, key=lambda x: x[2]):
            if k in known:
                continue
            end = min(expire or now + self.limits.ttl_ms, now + self.limits.most_ttl_ms)
            j = self.jobs[k] = [kind, "waiting", now, now + low if low is not None else 0, end, None, None]
            if low is not None and (low < 0 or low > self.limits.most_ttl_ms):
                j[1] = "bad config"
            elif end <= now:
                j[1] = "expired"
            elif used[kind] < self.limits.per_type:
                used[kind] += 1
                fits.append(k)
            elif self.oldest(kind):
                self.jobs[self.oldest(kind)[0][2]][1] = "dropped"
                fits.append(k)
            else:
                j[1] = "local limit"
        total = sum(j[1] in jobs.ALIVE for k, j in self.jobs.items() if k not in fits)
        for k in fits:
            if total >= self.limits.total:
                self.jobs[k][1] = "global limit"
            else:
                total += 1


def batches():
    rnd = random.Random(12)
    names = [f"j{i:03d}" for i in range(160)]
    out = []
    for b in range(6):
        now = NOW + b * DAY
        new = [(k, rnd.choice("ab"), b * 1000 + i, rnd.choice([None, 0, 500, -1, 400 * DAY]), rnd.choice([None, None, now + DAY, now, now + 900 * DAY])) for i, k in enumerate(rnd.sample(names, 40))]
        outcomes = [(k, rnd.choice(["ok", "recoverable", "recoverable", "permanent"])) for k in rnd.sample(names, 50)]
        out.append((now, new, outcomes))
    return out


SCHEMA = "kind string, now_ms long, job_id string, type string, order long, ready_ms long, min_ms long, max_ms long, expire_ms long, ttl_ms long, outcome string"


def frame(spark, now, new, outcomes):
    rows = [("new", now, k, t, o, None, low, None, e, None, None) for k, t, o, low, e in new] + [("outcome", now, k, None, None, None, None, None, None, None, x) for k, x in outcomes]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("per_type", "count", "also"), [(22, 6, {"retryable", "dropped", "ready", "done", "failed", "global limit"}), (9, 2, {"local limit"})])
def test_versions(spark, tmp_path, per_type, count, also):
    """Six batches, one of them repeated as after a failure; the table agrees with the queue after each."""
    limits = jobs.Limits(per_type=per_type, total=40, retries=2)
    table, queue = jobs.JobTable(spark, str(tmp_path / "jobs"), limits), Queue(limits)
    seen = set()
    for n, (now, new, outcomes) in enumerate(batches()[:count]):
        df = frame(spark, now, new, outcomes)
        table.apply(df, n)
        if n == 3:
            table.apply(df, n)
        queue.step(new, outcomes, now)
        got = {r.job_id: [r.type, r.state, r.created_ms, r.ready_ms, r.expire_ms, r.attempts_left, r.queued_ms] for r in table.version().collect()}
        assert got == queue.jobs, n
        seen |= {j[1] for j in queue.jobs.values()}
    assert seen >= {"waiting", "expired", "bad config", *also}
    assert len(table._versions()) == 2


def test_stream_of_batches(spark, tmp_path):
    limits, queue = jobs.Limits(per_type=22, total=40), None
    queue = Queue(limits)
    for now, new, outcomes in batches()[:2]:
        frame(spark, now, new, outcomes).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        queue.step(new, outcomes, now)
        table = jobs.JobTable(spark, str(tmp_path / "jobs"), limits)
        table.follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    assert {r.job_id: r.state for r in table.version().collect()} == {k: j[1] for k, j in queue.jobs.items()}


def test_restart(spark):
    rows = [("a", "t", "running", NOW, 0, NOW + DAY, None, None), ("b", "t", "waiting", NOW + 2 * DAY, 0, NOW + 9 * DAY, None, None), ("c", "t", "ready", NOW, 0, NOW, None, None), ("d", "t", "done", NOW, 0, NOW + DAY, None, None), ("e", "t", "ready", NOW, 0, NOW + 1, None, None)]
    s = spark.createDataFrame(rows, jobs.STATE)
    assert {r.job_id: r.state for r in jobs.restored(s, F.lit(NOW), True).collect()} == {"a": "lost", "b": "purged", "c": "expired", "e": "ready"}
    assert {r.job_id: r.state for r in jobs.restored(s, F.lit(NOW)).collect()}["a"] == "running"


def test_delays_are_drawn_in_their_range(spark):
    new = spark.createDataFrame([(f"j{i}", "t", i, None, 100, 200, None, None) for i in range(300)] + [("x", "t", 999, None, 200, 100, None, None), ("y", None, 1, None, None, None, None, None), (None, "t", 1, None, None, None, None, None)], "job_id string, type string, order long, ready_ms long, min_ms long, max_ms long, expire_ms long, ttl_ms long")
    got = jobs.registered(spark.createDataFrame([], jobs.STATE), new, F.lit(NOW), jobs.Limits()).collect()
    ready = [r.ready_ms - NOW for r in got if r.state == "waiting"]
    assert len(ready) == 300 and min(ready) >= 100 and max(ready) <= 200 and len(set(ready)) > 60
    assert sorted(r.job_id for r in got if r.state == "bad config") == ["x", "y"]


def match(before, after):
    if not before or not after:
        return False
    squeeze = lambda x: "".join(c for c in x.lower() if c not in " \t\n\x0b\f\r")
    b, a = squeeze(before), squeeze(after)
    if before == after or a == b or (len(b) >= 6 and b in a):
        return True
    odd = lambda x: "".join(c if " " <= c <= "\x7f" else "�" for c in x)
    at = odd(a).find(odd(b))
    if "�" in a and at >= 0:
        pairs = [(x, y) for x, y in zip(b, a[at : at + len(b)], strict=True) if x != y]
        if any(y != "�" or " " <= x <= "\x7f" for x, y in pairs):
            return False
        if len(pairs) < 0.2 * len(a) and "�" * 3 not in a:
            return True
    rest = iter(b)
    return len(b) > len(a) > 12 and len(a) > 0.75 * len(b) and all(c in rest for c in a)


def test_titles(spark):
    rnd = random.Random(4)
    base = ["Café society news of today", "A long enough headline here", "Short", "Über  Öl", "naïve résumé", "x", "", None, "The quick brown fox jumps"]
    pairs = [(b, a) for b in base for a in base]
    for b in base:
        for _ in range(25):
            if b:
                edit = rnd.choice([lambda s: s.upper(), lambda s: s + " - Site", lambda s: s[2:], lambda s: s[:-2], lambda s: "".join(c if ord(c) < 128 else "�" for c in s), lambda s: "pre " + "".join(c if ord(c) < 128 else "�" for c in s), lambda s: s.replace("e", "�"), lambda s: "".join(c for c in s if rnd.random() > 0.1), lambda s: s.replace(" ", "\n\t")])
                pairs += [(b, edit(b)), (edit(b), b)]
    got = spark.createDataFrame(pairs, "b string, a string").select("b", "a", sanitize.titles_match(F.col("b"), F.col("a")).alias("m")).collect()
    for r in got:
        assert r.m == match(r.b, r.a), (r.b, r.a)
    assert 50 < sum(r.m for r in got) < len(got) - 50


@pytest.mark.parametrize(("before", "after", "public"), [("Session of Jane Roe", "Session", False), ("Session", "Session of all", True), ("Welcome, Jane Roe", "Welcome, guest", False)])
def test_private_parts_of_titles_stay_private(spark, before, after, public):
    """What only the page before has is not public, even if the copy's title stands in it."""
    assert spark.createDataFrame([(before, after)], "b string, a string").select(sanitize.titles_match(F.col("b"), F.col("a")).alias("m")).first().m is public
