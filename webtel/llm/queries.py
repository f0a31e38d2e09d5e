"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.llm import ann, embed_dedup, licenses, line_dedup, packing, pii, resampling, secret_scan, simhash, sp_codec, substring, toxicity, whitening
from webtel.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(F.concat_ws(",", pii.base_spans()), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts, base, F.concat_ws(",", pii.all_spans()).alias("spans"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp_codec.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.digest_without_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("out").alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.sha2(secret_scan.listed(secret_scan.KINDS), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts, base, secret_scan.listed((*secret_scan.KINDS, "random")).alias("spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.digest_without_common_lines(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.col("out").alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_packing": op6_packing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.y FROM r JOIN l ON r.m = l.x),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
d AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = n LEFT JOIN d ON vec_id = x
""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
h AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS lowest FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM h JOIN f USING (h) WHERE doc_id > lowest),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM t ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op12_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
k AS (SELECT doc_id, line, p, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS kept FROM k ANTI JOIN c USING (key) GROUP BY doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
""",
    #: The CRC-32 of each distinct word, bit by bit; the rest is counting.
    "op13_importance_resampling": """
WITH w AS (SELECT doc_id, true AS raw, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL SELECT NULL, false, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
n AS (SELECT doc_id, raw, word, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT word, hex(word) AS x FROM (SELECT DISTINCT word FROM n)),
b AS (SELECT word, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, (length(x) // 2)::BIGINT), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
  lambda c, y: list_reduce(list_prepend(xor(c, y), range(0, 8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))) AS crc FROM h),
u AS (SELECT word, xor(crc, 4294967295) % 10000 AS bucket FROM b),
k AS (SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t FROM n JOIN u USING (word) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM k),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM k, a),
f AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN u USING (word) JOIN g USING (bucket) WHERE raw GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, substr(sha256('2024:' || d.doc_id), 1, 8) AS x FROM documents d LEFT JOIN f USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, ('0x' || x)::BIGINT AS h FROM e),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM z),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 10 * total // 100 THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)
""",
}
