"""Rules that change, break and come back while a stream runs."""

import dataclasses
import json

from webtel.streaming import flows, rules

NOW = 1_700_000_000_000
ONE = {"_meta": {"minVersion": 1}, "r": {"input": {"a": {"x": ("text", [])}}}}
TWO = {"r": {"input": {"p": {"x": ("text", [])}}}}


def test_polling(spark, tmp_path):
    path = tmp_path / "rules.json"
    f = rules.polled(spark, str(path), rules.Feed(), NOW)
    assert f.rules is None and f.failures == 1 and 6_666 <= f.wait_until - NOW <= 15_000
    assert rules.polled(spark, str(path), f, NOW + 1) == f
    path.write_text(json.dumps(ONE))
    f = rules.polled(spark, str(path), f, f.wait_until)
    assert f.rules["r"] and f.failures == 0 and f.changed_at == 0 and rules.USUAL_MS[0] <= f.wait_until - f.read_at <= rules.USUAL_MS[1]
    path.write_text(json.dumps(TWO))
    assert rules.polled(spark, str(path), f, f.wait_until - 1) == f
    g = rules.polled(spark, str(path), f, f.wait_until)
    assert list(g.rules) == ["r"] and g.changed_at == g.read_at and rules.FAST_MS[0] <= g.wait_until - g.read_at <= rules.FAST_MS[1]
    same = rules.polled(spark, str(path), g, g.wait_until)
    assert same.changed_at == g.changed_at and same.wait_until - same.read_at >= rules.USUAL_MS[0]
    h = same
    for n, broken in enumerate(["{", "[]", json.dumps({"_meta": {"minVersion": 99}}), json.dumps({"r": {"input": {"a": {"x": ("text", [("nonsense",)])}}}}), " " * (1 << 20) + "{}"]):
        path.write_text(broken)
        h = rules.polled(spark, str(path), h, h.wait_until)
        assert h.failures == n + 1 and h.rules == TWO | {"r": {"input": {"p": {"x": ["text", []]}}}}
        assert 10_000 * (n + 1) / 1.5 - 1 <= h.wait_until - h.read_at <= 15_000 * (n + 1)
    path.write_text(json.dumps(ONE))
    assert rules.polled(spark, str(path), h, h.wait_until).failures == 0


def test_times_from_the_future_start_afresh():
    f = rules.Feed("{}", NOW, 0, NOW, NOW)
    assert rules.sound(f, NOW) == f
    for field, ahead in (("read_at", 300_000), ("changed_at", 300_000), ("wait_until", 300_000 + 24 * rules.HOUR_MS)):
        assert rules.sound(dataclasses.replace(f, **{field: NOW + ahead}), NOW) == rules.Feed()
        assert rules.sound(dataclasses.replace(f, **{field: NOW + ahead - 1}), NOW) != rules.Feed()


def test_batches_see_the_rules_of_their_time(spark, tmp_path):
    path, seen, now = tmp_path / "rules.json", [], [NOW]
    for i in range(4):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def clock():
        now[0] += 30 * rules.HOUR_MS
        n = len(seen) + skipped.count(1)
        if n == 0 and not skipped:
            skipped.append(1)
        elif n == 1:
            path.write_text(json.dumps(ONE))
        elif n == 2:
            path.write_text(json.dumps({"two": TWO["r"]}))
        else:
            path.write_text("broken")
        return now[0]

    skipped: list[int] = []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    use = rules.RuledStream(str(path), lambda df, r, n: seen.append((n, sorted(r), df.count())), clock)
    flows.run_to_end(stream, "", str(tmp_path / "checkpoint"), "append", use)
    assert [(n, names) for n, names, _ in seen] == [(1, ["_meta", "r"]), (2, ["two"]), (3, ["two"])]
