"""Line dedup, importance resampling and whitening against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webtel.llm import line_dedup, queries, resampling, whitening

CLASHING = "doc_id long, text string, id string, rid int, keep int, n_dropped int, pos int, _c0 string, line string, h1 int"


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    common = ["Share this page", " share THIS page\t", "\x0bShare this page\r", "É x", "é x", "", "  ", "Menu", "menu ", "Ünter 漢字 😀"]
    texts = [None, "", "\n", "\n\n", "a", " \t", "x" * 50_000, "Menu\n" * 5_000, "\n".join(f"line {i}" for i in range(9_000)), "A\nb\nA", "a\r\nB\r\n"]
    texts += ["\n".join(rnd.choice(common) if rnd.random() < 0.5 else f"own {rnd.randint(0, 60)}" for _ in range(rnd.randint(1, 12))) for _ in range(120)]
    found = list(enumerate(texts))
    found += [(20, texts[20]), (20, "Menu\nother"), (None, "Menu\nnull id"), (None, "Menu\nnull id"), (None, None)]
    rnd.shuffle(found)
    return found


def common_keys(rows, least, chars=1):
    seen = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add((i, t))
    return {k for k, d in seen.items() if len(k) >= chars and len(d) >= least}


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def lines_brute(rows, least=10, chars=1):
    gone = common_keys(rows, least, chars)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize(("parts", "least", "chars"), [("1", 10, 1), ("4", 10, 1), ("40", 10, 1), ("40", 2, 3), ("40", 60, 1)])
def test_lines(spark, rows, parts, least, chars):
    """Few and many ranges: with forty, a common line is cut over several tasks."""
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y", "z", 5) for i, t in rows], CLASHING).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.digest_without_common_lines(df, least, chars).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert bag(got) == bag(lines_brute(rows, least, chars))


@pytest.mark.parametrize("parts", ["1", "30"])
def test_first_line_stays(spark, parts):
    rnd = random.Random(6)
    rows = [(i, "\n".join(f"l{rnd.randint(0, 25)}" for _ in range(rnd.randint(1, 9)))) for i in range(80)]
    seen, want = set(), {}
    several = common_keys(rows, 2)
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if x not in several or x not in seen:
                kept.append(x)
            seen.add(x)
        want[i] = "\n".join(kept)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.text for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id int, text string"), 2, keep_first=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_cut_texts_keep_their_columns(spark):
    df = spark.createDataFrame([(i, f"Foot\nbody {i}", "x", 1, 2, 3, 4, "y", "z", 5) for i in range(12)] + [(99, None, None, None, None, None, None, None, None, None)], CLASHING)
    got = line_dedup.drop_common_lines(df)
    assert got.columns == [c for c in df.columns if c != "n_dropped"] + ["n_dropped"]
    assert {(r.doc_id, r.text, r.id, r.keep, r.n_dropped) for r in got.collect()} == {(i, f"body {i}", "x", 2, 1) for i in range(12)} | {(99, None, None, None, 0)}


def test_bitmaps_are_small(spark):
    got = line_dedup.keep_bitmaps(spark.createDataFrame([(i, "a\n" * 10_000 + f"own {i}\nb") for i in range(10)], "doc_id int, text string")).collect()
    assert len(got) == 10
    for r in got:
        assert r.n_dropped == 10_001 and len(r.keep) < 100
        assert np.flatnonzero(line_dedup.kept_lines(bytes(r.keep), 10_002)).tolist() == [10_000]
        assert np.flatnonzero(line_dedup.kept_lines(bytes(r.keep), 10_020)).tolist() == [10_000, *range(10_002, 10_020)]


def test_keys_lower_a_to_z_alone(spark):
    """Letters that Unicode would lower, blanks that are not ASCII, and lengths in code points."""
    odd = ["K", "k", "\u212a", "\u0130", "i\u0307", "\u03a3", "\u03c3", "É", "é", "ẞ", "ß", "\xa0k", "\x85k", "\x1ck", "\u2028k", "k\rk", "éé", "ÉÉ", "漢字", "\x00", "😀a", "😀A"]
    docs = [(i, "\n".join(x for j, x in enumerate(odd) if (i + j) % 3)) for i in range(15)] + [(i, "\n".join(odd[i % 7 :])) for i in range(15, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least, chars in ((10, 1), (18, 1), (10, 2), (10, 3)):
        assert bag(line_dedup.digest_without_common_lines(df, least, chars).collect()) == bag(lines_brute(docs, least, chars))


def test_long_texts_take_small_buffers(spark):
    """Lines are handed on in parts, texts are read in short vectors, and no sort holds them: each grew the executors' heaps."""
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "rid": [3, 4], "t": ["\n".join(map(str, range(120_000))), "5\n\n 7 "]})
    parts = list(line_dedup._hashed(1)(iter([batch])))
    assert [p.num_rows for p in parts] == [50_000, 50_000, 20_002]
    t = pa.Table.from_batches(parts).to_pydict()
    assert t["pos"] == [*range(120_000), 0, 2] and t["id"][-2:] == [2, 2] and t["rid"][-2:] == [4, 4]
    hashes = list(zip(t["h1"], t["h2"], strict=True))
    assert len(set(hashes)) == 120_000 and hashes[-2:] == [hashes[5], hashes[7]]

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = [(i, f"Foot\nbody {i}") for i in range(12)]
        got = line_dedup.digest_without_common_lines(spark.createDataFrame(docs, "doc_id long, text string"))
        assert bag(got.collect()) == bag(lines_brute(docs))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan.split("Initial Plan")[0] and "SortMergeJoin" not in plan.split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256


def test_no_lines(spark):
    assert line_dedup.digest_without_common_lines(spark.createDataFrame([], CLASHING)).count() == 0
    assert line_dedup.drop_common_lines(spark.createDataFrame([], CLASHING)).count() == 0


# --- resampling


def resampled_brute(rows, target, low, high, buckets, seed, percent, least):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    raw = collections.Counter(b for _, t in rows for b in features(t)[1])
    aim = collections.Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(raw.values()) + buckets, sum(aim.values()) + buckets
    out = []
    for i, t in rows:
        n, f = features(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[5] = k + 1
    return [(r[0], *r[2:]) for r in out]


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 5)])
def test_resampling(spark, low, high):
    rnd = random.Random(7)
    vocab = ["The", "fox", "éTÉ", "漢字", "a1", "3.5", "don't", "x", "Zürich", "😀"]
    texts = [None, "", " .,", "fox", "fox fox", "x" * 30_000, "a b " * 20_000, *[" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(150)]]
    rows = [*enumerate(texts), (30, texts[30]), (None, texts[31]), (None, None)]
    target = [None, "", *[" ".join(rnd.choice(vocab[:5]) for _ in range(30)) for _ in range(8)]]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, id string, rank int, weight int, n int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, aim, low, high, 997, 2024, 30).collect()
    want = resampled_brute(rows, target, low, high, 997, 2024, 30, 20)
    assert bag(got) == bag(want)
    assert sum(r.rank is not None for r in got) > 20


def test_no_target_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    none = docs.limit(0)
    assert bag(resampling.resample(docs, none).collect()) == bag(resampled_brute([(1, "a b c"), (2, None)], [], 1, 1, 10_000, 2024, 10, 20))
    assert resampling.resample(none, docs).count() == 0


def test_suffix_arrays_sort_whole_grams():
    rnd = np.random.default_rng(1)
    for n, depth in ((1, 3), (2, 1), (200, 1), (200, 3), (300, 7), (64, 40)):
        ids = np.append(rnd.integers(0, 4, n - 1), 0).astype(np.int32)
        order = resampling.suffix_array(ids, depth)
        padded = [*ids.tolist(), *[-1] * depth]
        assert order.tolist() == sorted(range(n), key=lambda p: (padded[p : p + depth], p)) or [padded[p : p + depth] for p in order] == sorted(padded[p : p + depth] for p in range(n))
        lcp = resampling.common_prefixes(ids, order, depth)
        for k in range(1, n):
            same = 0
            while same < depth and padded[order[k] + same] == padded[order[k - 1] + same] and padded[order[k] + same] > 0:
                same += 1
            assert lcp[k] == same


def test_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 7)
    monkeypatch.setattr(resampling, "CHUNK", 20)
    ids = resampling.Ids()
    parts = np.concatenate(list(ids.of(b"One two; three one TWO-three four" + b"y" * 40 + b" one")))
    assert [list(ids)[i - 1] for i in parts] == [b"one", b"two", b"three", b"one", b"two", b"three", b"four" + b"y" * 40, b"one"]


# --- whitening


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def check_whitening(rows, got, dims, components=16):
    good = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) + 1_000_000) for i, v in rows if usable(v) and len(v) == dims]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in good}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, dims, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(good)
    want = collections.defaultdict(list)
    for i, x in good:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total, strict=True))
        want[i, deviation].append((x - total / n) @ axes[:, :k] / np.sqrt(e[:k]))
    signs = {}
    for r in sorted(got, key=lambda r: (-abs(r.whitened), r.component)):
        near = [w[r.component - 1] for w in want[r.id, r.deviation]]
        assert near and r.n == n
        signs.setdefault(r.component, np.sign(r.whitened * near[0]) or 1)
        assert min(abs(signs[r.component] * r.whitened - w) for w in near) < 1e-6
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-8 * r.explained
        assert r.identity_error < 1e-9
    return k


@pytest.mark.parametrize(("dims", "many"), [(1, 40), (2, 3), (7, 300), (20, 2500)])
def test_whitening(spark, dims, many):
    rnd = np.random.default_rng(dims)
    x = (rnd.normal(size=(many, dims)) * (1 + np.arange(dims)) @ rnd.normal(size=(dims, dims))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000 + i, v) for i, v in enumerate([None, [], [float("nan")] * dims, [None] * dims, [float("inf")] * dims, [0.0] * dims, [1.0] * (dims + 1)])]
    rows += [(None, x[1].tolist()), (0, x[0].tolist()), *[(10_000 + i, x[2].tolist()) for i in range(50)]]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, id string, x int, component double").repartition(3)
    got = whitening.whiten(df).collect()
    assert check_whitening(rows, got, dims) == min(dims, 16)


def test_few_vectors_have_few_components(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0]), (3, [2.0, 2.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert check_whitening(rows, got, 3) == 1
    one = spark.createDataFrame(rows[1:], "vec_id int, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0


def test_large_deviations(spark):
    """Exact while it fits a long; null beyond."""
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 3.0]), (3, [1e30, 0.0])]
    got = {r.id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows[:2], "vec_id int, embedding array<double>")).collect()}
    assert got == {i: 2 * 0 + (64 * 2 * 10**6) ** 2 + (64 * 3) ** 2 for i in (1, 2)}
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()} == {None}


def test_triangles_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rnd = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(200, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert check_whitening(rows, whitening.whiten(df).collect(), 5) == 5


def test_jacobi_keeps_small_values():
    """Lengths over sixteen orders of magnitude, where a covariance would lose the small ones."""
    rnd = np.random.default_rng(4)
    q, _ = np.linalg.qr(rnd.normal(size=(12, 12)))
    s = 10.0 ** -np.arange(0, 24, 2)
    got, axes = whitening.jacobi(q * s)
    assert np.allclose(got, s, rtol=1e-12, atol=0) and np.allclose(axes.T @ axes, np.eye(12), atol=1e-14)
    got, axes = whitening.jacobi(np.diag([0.0, 2.0, 0.0]))
    assert got.tolist() == [2.0, 0.0, 0.0] and abs(axes[1, 0]) == 1


def test_queries(spark, tmp_path):
    """The registered queries on tables with nulls, repeats and clashing columns."""
    docs = [(i, t) for i, t in [(0, None), (1, ""), (2, "Foot\nIt is " + "one two three " * 10)]] + [(i, "foot \nword " * 30) for i in range(3, 14)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, rank int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vectors = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.5])]
    spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, id string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_line_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and bag(got.collect()) == bag(lines_brute(docs))
    got = queries.op13_importance_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank")
    assert bag(got.collect()) == bag(resampled_brute(docs, ["one two", None], 1, 1, 10_000, 2024, 10, 20))
    got = queries.op11_embedding_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(vectors, got.withColumnRenamed("vec_id", "id").collect(), 2)
    for name in ("documents", "embeddings"):
        empty = tmp_path / "none"
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).where(F.lit(False)).write.parquet(str(empty / f"{name}.parquet"))
    spark.createDataFrame([], "text string").write.parquet(str(empty / "benchmark.parquet"))
    for f in (queries.op11_embedding_whitening, queries.op12_line_dedup, queries.op13_importance_resampling):
        assert f(spark, str(empty)).count() == 0
