"""Queries of the identifier model, of masking and of public suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.functions import classify, masking, sanitize, urls
from webtel.operators import suffixes
from webtel.plans.registry import _HOST, _PATH, _segments, query
from webtel.sources.tables import table

#: Weights for the query that is compared with SQL; `identifier_fit` and the masks use fitted ones.
WEIGHTS = dict(zip(("bias", *classify.FEATURES), (3.0, -60.0, -0.4, 2.0, -1.0, 4.0), strict=True))


def _pairs(spark: SparkSession, d: str):
    return classify.bigram_model(table(spark, d, "conversations"), "text", alphabet=classify.KNOWN)


def examples(spark: SparkSession, d: str) -> DataFrame:
    """(text, label): runs of one to three words joined by hyphens, and digests of the same words in two alphabets."""
    words = table(spark, d, "conversations").select(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ").alias("w"))
    runs = words.select(F.explode(F.transform("w", lambda x, i: F.array_join(F.slice("w", i + 1, 1 + i % 3), "-"))).alias("text")).where(F.length("text") >= 6).distinct()
    length = (10 + F.pmod(F.xxhash64("text"), F.lit(20))).cast("int")
    hexed = F.substr(F.sha2("text", 256), F.lit(1), length)
    mixed = F.substr(F.regexp_replace(F.base64(F.unhex(F.sha2("text", 512))), "[+/=]", ""), F.lit(1), length)
    digest = F.when(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(2)) == 0, hexed).otherwise(mixed)
    return runs.select(F.explode(F.array(F.struct("text", F.lit(0).alias("label")), F.struct(digest.alias("text"), F.lit(1).alias("label")))).alias("e")).select("e.*")


def fitted(spark: SparkSession, d: str) -> classify.IdentifierModel:
    return classify.fit_identifiers(examples(spark, d), "text", "label", _pairs(spark, d))


@query(f"""
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9. -]+')) AS w FROM conversations),
g AS (SELECT w[i:i + 1] AS g, count(*) AS n FROM (SELECT w, unnest(range(1, length(w))) AS i FROM w) GROUP BY 1),
a AS (SELECT substr('{classify.KNOWN}', i::INT, 1) AS c FROM range(1, {len(classify.KNOWN) + 1}) t(i)),
m AS (SELECT a.c || b.c AS g, ln((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a.c)) AS lp FROM a CROSS JOIN a b LEFT JOIN g ON g.g = a.c || b.c),
s AS (SELECT DISTINCT unnest(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS segment FROM pages),
l AS (SELECT segment, lower(segment) AS x, regexp_replace(lower(segment), '[^a-z0-9. -]', '', 'g') AS kept FROM s),
p AS (SELECT segment, exp(avg(lp)) AS probability FROM (SELECT segment, kept, unnest(range(1, length(kept))) AS i FROM l) JOIN m ON g = kept[i:i + 1] GROUP BY segment),
e AS (SELECT segment, 0.0 - sum(q * log2(q)) AS entropy FROM (SELECT segment, count(*) / length(any_value(x)) AS q FROM (SELECT segment, x, unnest(range(1, length(x) + 1)) AS i FROM l) GROUP BY segment, x[i:i]) GROUP BY segment),
f AS (SELECT segment, x, coalesce(probability, 1.0) AS probability, entropy, length(regexp_replace(x, '[^0-9a-f]', '', 'g')) / length(x) AS hex,
  coalesce(length(regexp_replace(x, '[^aeiou]', '', 'g')) / nullif(length(regexp_replace(x, '[^a-z]', '', 'g')), 0), 0.0) AS vowels, regexp_replace(x, '[^a-z0-9]', '', 'g') AS plain FROM l JOIN e USING (segment) LEFT JOIN p USING (segment)),
t AS (SELECT *, coalesce(len(list_filter(range(1, length(plain)), lambda i: (plain[i:i] BETWEEN '0' AND '9') <> (plain[i + 1:i + 1] BETWEEN '0' AND '9'))) / nullif(length(x) - 1, 0), 0.0) AS transitions FROM f),
r AS (SELECT *, CASE WHEN length(segment) < 6 OR regexp_full_match(segment, '[0-9]+(x[0-9]+)?') OR regexp_full_match(x, '[a-z][a-z]?[0-9][0-9a-z]?[0-9][a-z][a-z]') THEN 0.0
  ELSE 1 / (1 + exp(-({WEIGHTS["bias"]} + {" + ".join(f"{k} * {WEIGHTS[k]}" for k in classify.FEATURES)}))) END AS score FROM t)
SELECT segment, round(probability, 6) AS probability, round(entropy, 6) AS entropy, round(hex, 6) AS hex, round(vowels, 6) AS vowels, round(transitions, 6) AS transitions, round(score, 6) AS score FROM r
""")
def identifier_scores(spark, d):
    """Features of path segments and the score of a model with given weights."""
    model = classify.IdentifierModel(_pairs(spark, d), WEIGHTS["bias"], tuple(WEIGHTS[k] for k in classify.FEATURES))
    s = _segments(spark, d).select("segment").distinct()
    s = s.select("segment", classify.identifier_features(F.col("segment"), model.pairs).alias("f"), classify.identifier_score(F.col("segment"), model).alias("score"))
    return s.select("segment", *[F.round(f"f.{k}", 6).alias(k) for k in classify.FEATURES], F.round("score", 6).alias("score"))


@query()
def identifier_fit(spark, d):
    """How the fitted model judges the examples, by label: right and wrong."""
    model = fitted(spark, d)
    judged = examples(spark, d).withColumn("identifier", classify.identifier_score(F.col("text"), model) > model.cut)
    return judged.groupBy("label", "identifier").agg(F.count(F.lit(1)).alias("n"))


@query()
def mask_path(spark, d):
    return masking.mask_column(_segments(spark, d), "segment", fitted(spark, d))


@query()
def mask_host(spark, d):
    hosts = table(spark, d, "pages").select("page_id", urls.part(F.col("url"), "host").alias("host"))
    return masking.mask_hosts(hosts, "host", fitted(spark, d))


#: Rules of every kind: plain, of several labels, wildcards, exceptions, private ones.
RULES = (("com", False), ("net", False), ("uk", False), ("co.uk", False), ("ck", False), ("*.ck", False), ("!www.ck", False), ("*.kawasaki.jp", False), ("jp", False), ("!city.kawasaki.jp", False), ("blog.example.net", True), ("*.store.com", True))
#: What the last two labels of the pages' hosts are replaced with, by page.
_ENDS = ("example.com", "example.net", "ck", "www.ck", "shop.co.uk", "kawasaki.jp", "city.kawasaki.jp", "eu.store.com", "unlisted")


@query(f"""
WITH r AS (SELECT unnest([{", ".join(f"'{r}'" for r, _ in RULES)}]) AS rule),
p AS (SELECT page_id, regexp_replace({_HOST}, '[^.]+\\.[^.]+$', '') || [{", ".join(f"'{e}'" for e in _ENDS)}][page_id % {len(_ENDS)} + 1] AS host FROM pages),
l AS (SELECT page_id, host, string_split(host, '.') AS l, len(string_split(host, '.')) AS n FROM p),
x AS (SELECT page_id, n, unnest(range(1, n + 1)) AS k, l FROM l),
s AS (SELECT page_id, k, array_to_string(l[n - k + 1:], '.') AS suffix, array_to_string(l[n - k + 2:], '.') AS behind FROM x),
m AS (SELECT page_id, max(k) FILTER (suffix IN (SELECT rule FROM r) OR '*.' || behind IN (SELECT rule FROM r)) AS k, max(k - 1) FILTER ('!' || suffix IN (SELECT rule FROM r)) AS e FROM s GROUP BY page_id),
b AS (SELECT page_id, host, l, n, coalesce(e, k, 1) AS k FROM l JOIN m USING (page_id))
SELECT page_id, host, array_to_string(l[n - k + 1:], '.') AS suffix, CASE WHEN n > k THEN array_to_string(l[n - k:], '.') END AS domain FROM b
""")
def suffix_domains(spark, d):
    """Domains of hosts under a table of rules with wildcards and exceptions."""
    ends = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (F.col("page_id") % len(_ENDS) + 1).cast("int"))
    hosts = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace(urls.part(F.col("url"), "host"), r"[^.]+\.[^.]+$", ""), ends).alias("host"))
    return suffixes.with_domain(hosts, "host", spark.createDataFrame(RULES, "rule string, private boolean"))


# --- titles -----------------------------------------------------------------------------------------------------

#: What becomes of a text in the anonymous copy, by page, in both languages.
_TITLE = "'Nouvelle Séance ' || page_id || ' of the longer kind of titles'"
_COPIES = ("upper(t)", "t || ' - Site'", "replace(t, 'é', chr(65533))", "replace(t, 'the ', '')", "substr(t, 1, 20)", "'Other ' || t", "replace(replace(t, ' ', ''), 'k', 'K')", "replace(replace(t, 'é', chr(65533)), 'l', chr(65533))")


@query(f"""
WITH t AS (SELECT page_id, {_TITLE} AS t FROM pages),
p AS (SELECT page_id, t, CASE page_id % {len(_COPIES)} {" ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_COPIES))} END AS c FROM t),
n AS (SELECT page_id, regexp_replace(lower(t), '\\s', '', 'g') AS b, regexp_replace(lower(c), '\\s', '', 'g') AS a FROM p),
m AS (SELECT *, strpos(regexp_replace(a, '[^\\x20-\\x7f]', chr(65533), 'g'), regexp_replace(b, '[^\\x20-\\x7f]', chr(65533), 'g')) AS pos FROM n),
k AS (SELECT *, list_filter(range(1, length(b) + 1), lambda i: b[i:i] <> substr(a, (pos + i - 1)::INT, 1)) AS changed FROM m)
SELECT page_id, a = b OR (length(b) >= 6 AND contains(a, b))
  OR (contains(a, chr(65533)) AND pos > 0 AND len(list_filter(changed, lambda i: substr(a, (pos + i - 1)::INT, 1) <> chr(65533) OR regexp_matches(b[i:i], '[\\x20-\\x7f]'))) = 0 AND len(changed) < 0.2 * length(a) AND NOT contains(a, repeat(chr(65533), 3)))
  OR (length(b) > length(a) AND length(a) > 12 AND length(a) > 0.75 * length(b) AND regexp_matches(b, array_to_string(list_transform(string_split(a, ''), lambda x: regexp_escape(x)), '.*'))) AS public FROM k
""")
def title_matches(spark, d):
    """Whether titles may be published, given those of anonymous copies that differ in various ways."""
    p = table(spark, d, "pages").select("page_id", F.expr(_TITLE).alias("t"))
    copies = F.expr("CASE " + " ".join(f"WHEN page_id % {len(_COPIES)} = {i} THEN {c}" for i, c in enumerate(_COPIES)).replace("chr(65533)", "'\ufffd'") + " END")
    return p.withColumn("c", copies).select("page_id", sanitize.titles_match(F.col("t"), F.col("c")).alias("public"))
