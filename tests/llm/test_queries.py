"""The registered queries and the pipeline as they are called: on a folder of tables with every odd case."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import SCHEMA, bag, brute_fingerprint, brute_pii, brute_repeats, brute_secrets, check_packing, corpus, digest, vocabulary
from webtel.llm import queries

TOXIC = 2000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(21)
    words = vocabulary(rnd, 200)
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    out = corpus() + [(1000 + i, " ".join(some(30))) for i in range(150)]
    for i in range(150):
        ws = some(12)
        ws[6:6] = ["you", "are", "a", rnd.choice(["grumblewort", "snotgobbler"])]
        out.append((TOXIC + i, " ".join(ws)))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, x, "en", None, None, "t", "id", 1, 2, "_t") for i, x in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i >= TOXIC)) for i, _ in rows if i is not None and i >= 1000]
    spark.createDataFrame([*labels, (None, None, None), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rnd = np.random.default_rng(2)
    vectors = [(i, rnd.normal(size=8).tolist(), int(i % 3)) for i in range(300)]
    vectors += [(300 + i, [x * 1.001 for x in vectors[i][1]], vectors[i][2]) for i in range(20)]
    vectors += [(400, None, 1), (500, [0.0] * 8, 1), (600, [float("nan")] * 8, 1), (700, [None] * 8, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def span_counts(spans, kinds):
    return [sum(s.startswith(f"{k}:") for s in spans) for k in kinds]


@pytest.mark.parametrize(("name", "brute", "kinds"), [("op2_pii", brute_pii, ("email", "ip", "card", "phone")), ("op10_secret_scan", brute_secrets, ("assign", "access", "hex"))])
def test_span_queries(spark, folder, rows, name, brute, kinds):
    got = queries.QUERIES[name](spark, folder).collect()
    base = [(i, brute(x or "")) for i, x in rows]
    assert bag((r.doc_id, *[r[f"n_{k}"] for k in kinds], r.base_sha256) for r in got) == bag((i, *span_counts(b, kinds), digest(",".join(b))) for i, b in base)
    least = {digest(",".join(b)): set(b) for _, b in base}
    assert all(least[r.base_sha256] <= set(r.spans.split(",")) for r in got)


def test_toxicity_query(spark, folder, rows):
    got = queries.op8_toxicity(spark, folder).collect()
    assert bag((r.doc_id,) for r in got) == bag((i,) for i, _ in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id is not None and r.doc_id >= TOXIC)


def test_fingerprint_query(spark, folder, rows):
    got = queries.op5_simhash_near_dedup(spark, folder)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert bag(got.select("doc_id", "fingerprint").collect()) == bag((i, f"{brute_fingerprint(x):016x}") for i, x in rows)


def test_vector_queries(spark, folder):
    links = queries.op4_embedding_near_dedup(spark, folder).collect()
    assert len(links) == 324 and all(r.kept == (r.vec_id == r.component_id) for r in links)
    assert {(r.vec_id, r.component_id) for r in links if 300 <= r.vec_id < 320} == {(300 + i, i) for i in range(20)}
    used = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 400").collect()
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in used}
    queried = (0, 100, 200, 300)
    want = {(q, i) for q in queried for _, i in sorted((float(((vectors[q] - v) ** 2).sum()), i) for i, v in vectors.items() if i != q)[:10]}
    got = queries.op7_nearest_neighbours(spark, folder).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in queried for k in range(1, 11)]
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 36
    assert all(abs(r.score - np.linalg.norm(vectors[r.query_id] - vectors[r.vec_id])) < 1e-9 for r in got)


def test_pipeline_run(spark, folder, rows):
    """What run() packs: the clean documents, one of each group, without later repeats and secrets."""
    kept = [(i, x) for i, x in rows if i is None or i < TOXIC]
    fps = [brute_fingerprint(x) for _, x in kept]
    comp = list(range(len(kept)))
    changed = True
    while changed:
        new = [min(comp[j] for j, g in enumerate(fps) if (f ^ g).bit_count() <= 3) for f in fps]
        comp, changed = new, new != comp
    first = {}
    for c, row in zip(comp, kept, strict=True):
        first[c] = min(first.get(c, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    kept = list(first.values())
    kept = [(i, x if not n else b" ".join(k).decode()) for (i, x), (_, _, n, k) in zip(kept, brute_repeats(kept), strict=True)]
    assert not any(s.startswith(("assign", "access")) for _, x in kept for s in brute_secrets(x or ""))
    kept = [(i, None if x is None else re.sub("[0-9a-f]{24,}", "[SECRET]", x)) for i, x in kept]
    got = corpus_pipeline.run(spark, folder).collect()
    check_packing(got, kept)
    assert {r.doc_id for r in got} == {i for i, _ in kept}


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
