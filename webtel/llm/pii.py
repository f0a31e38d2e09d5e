"""PII: base patterns, and information-theoretic sanitisation of revealing terms.

Personal data found by patterns are the protected entities. Terms anywhere in
a text that holds an entity are weighed by corpus co-occurrence: with p from
document frequencies over all documents, a term's disclosure of an entity is its
pointwise mutual information with it as a share of the entity's own
information, PMI(t; e) / IC(e), which is 1 when the term occurs only with the
entity. Terms above the upper threshold are removed, terms above the lower
one generalised.

Rare words also meet an entity by chance. A pair is reported only if its
count is significant: the tail of the hypergeometric distribution is bounded
by the relative entropy, and Benjamini-Hochberg holds the share of false
pairs, with every term and every entity as a test.

All counts are of distinct texts, however often they repeat. Near copies
prove nothing either: texts that share two least hashes of their runs of five
words are one class, and what a pair has beyond one text of each class is
taken out of all of its counts. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import small_side, text_key, without
from webtel.llm.spans import located, matches, named
from webtel.session import Stages

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the base patterns: what follows a repeated class never begins with a member of it, so
# giving back could not help. A match can only begin where the one before ended or no member of the class precedes.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only runs of 16 digits or more; shorter ones fail the length test anyway.
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: A term inside an address or a number with letters is no term.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
SUPPORT, GENERALISE, REMOVE, FALSE_SHARE = 2, 0.6, 0.9, 0.05
#: Classes of near copies: bands of two least hashes. Of texts with similarity 0.8 two in a thousand pairs share none.
BANDS, RUN = 6, 5
#: Tenths of a power of ten in which significance is counted; what is beyond the last counts as the last.
LEVELS = 5000
TERM_KINDS = ("generalise", "remove")
#: Keys with more than a HOT-th of the counted rows, of which there are fewer than HOT, are joined by broadcast.
HOT = 1000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def add(acc, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))


#: Kind -> (pattern, a cheap test of the text, the test of a match).
PATTERNS = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.contains("."), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": (CARD, None, _card),
    "phone": (PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(8, 15)),
}


def with_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tid, t, email, ip, card, phone): a row for each row of `docs`, with arrays of located spans; tid is the key of the text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    base = base.withColumn("tid", text_key(t))
    found = base.select("*", *[matches(t, p, test(t) if test else None).alias(f"m_{k}") for k, (p, test, _) in PATTERNS.items()])
    return found.select("id", "tid", "t", *[located(t, p, F.col(f"m_{k}"), keep).alias(k) for k, (p, _, keep) in PATTERNS.items()])


def _entities(texts: DataFrame) -> DataFrame:
    """(tid, entity): the distinct entities of each text."""

    def keys(k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.xxhash64(F.lit(k), F.lower(s["value"])))

    return texts.select("tid", F.explode(F.array_distinct(F.concat(*[keys(k) for k in KINDS]))).alias("entity"))


def _bound(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _bands(t: Column) -> Column:
    """BANDS hashes of a text, each of the runs of RUN words whose hashes are nearest to two fixed points."""

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - RUN), lambda i: F.xxhash64(*[h[i + k] for k in range(RUN)]))
        return F.when(F.size(h) >= RUN, each).otherwise(F.array(F.xxhash64(h)))

    def nearest(r: Column, point: int) -> Column:
        return F.array_min(F.transform(r, lambda x: x.bitwiseXOR(F.xxhash64(F.lit(point)))))

    words = F.transform(F.split(t, r"[\x20\t-\r]+"), lambda w: F.xxhash64(w))
    return _bound(words, lambda h: _bound(runs(h), lambda r: F.array(*[F.xxhash64(nearest(r, 2 * i), nearest(r, 2 * i + 1)) for i in range(BANDS)])))


def near_copies(texts: DataFrame, stages: Stages) -> DataFrame:
    """(tid, class) of `texts` (tid, bands): the least key of a text that shares a band, or shares one with such a text."""
    points = texts.select("tid", F.posexplode("bands").alias("i", "band"))
    labels = points.withColumn("class", F.col("tid.a"))
    for turn in range(2):
        shared = labels.groupBy("i", "band").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        least = labels.join(shared, ["i", "band"]).groupBy("tid").agg(F.min("least").alias("least"))
        labels = stages.write(labels.join(least, "tid", "left").select("tid", "i", "band", F.coalesce("least", "class").alias("class")), f"classes{turn}")
    return labels.where("i = 0").select("tid", "class")


def _terms(texts: DataFrame) -> DataFrame:
    """(tid, term): the distinct terms of each text."""
    return texts.select("tid", F.explode(F.array_distinct(F.transform(matches(F.col("t"), TERM), F.lower))).alias("term"))


def _same_texts(rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, n, xa, xb): the number of texts of each key, and their keys' exclusive or, which tells whether two keys stand in the same texts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.expr("bit_xor(tid.a)").alias("xa"), F.expr("bit_xor(tid.b)").alias("xb"))


def _joined(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, keep: Column | None = None) -> DataFrame:
    """`rows` joined with those of `counts` that `keep` accepts; no task gets all rows of a frequent key.

    `counts` has one row for each value of `keys`, with its number of rows in
    column `n`. Both are read more than once, so they are written tables.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) * HOT > total
    kept = counts if keep is None else counts.where(keep)
    frequent = rows.join(F.broadcast(kept.where(hot)), keys)
    others = rows.join(F.broadcast(counts.where(hot).select(*keys)), keys, "left_anti").join(kept.where(~hot), keys)
    return frequent.unionByName(others)


def document_frequency(docs: DataFrame, copies: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): the number of distinct texts that hold each word of three letters or more; `copies` has (tid, n) of repeated texts."""
    t = F.col(text_col).cast("string")
    words = F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))
    base = docs.select(t.alias("t"), text_key(F.coalesce(t, F.lit(""))).alias("tid")).join(small_side(copies, 48), "tid", "left")
    each = base.select(F.explode(words).alias("term"), (1 / F.coalesce("n", F.lit(1))).alias("part")).where(F.length("term") >= 3)
    return each.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("df"))


def most_df(df_e: Column, n_docs: int, generalise: float) -> Column:
    """The largest df of a term that can reach the lower threshold: it would stand in every document of the entity."""
    n = F.lit(float(max(n_docs, 2)))
    return df_e * F.pow(n / df_e, F.lit(1.0 - generalise)) * (1 + 1e-9)


def evidence(k: Column, draws: Column, chance: Column) -> Column:
    """-log10 of a bound of the chance that `k` or more of `draws` hit by accident: draws times the relative entropy."""
    a, p = k / draws, F.least(chance, F.lit(1.0))
    rest = F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - p))).otherwise(0.0)
    return F.when(a > p, draws * (a * F.ln(a / p) + rest) / math.log(10)).otherwise(0.0)


def least_level(counts: list[tuple[int, int]], tests: float, false_share: float) -> int:
    """Benjamini-Hochberg on tenths of a power of ten: the least level at which enough pairs lie at or above it."""
    least, above = LEVELS + 1, 0
    for level, n in sorted(counts, reverse=True):
        above += n
        if math.log10(max(tests, 1.0)) - level / 10 <= math.log10(false_share * above):
            least = level
    return least


def disclosing(pairs: DataFrame, n_texts: int, tests: float, stages: Stages, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, false_share: float = FALSE_SHARE) -> DataFrame:
    """(entity, term, both, action) of `pairs` (tid, class, entity, df_e, many, term, df); no action below the lower threshold.

    `many` entities stand in the same texts as this one and share its fate,
    and all count in the number of `tests`. At most LEVELS counts come to
    the driver.
    """
    own = [F.first(c).alias(c) for c in ("df_e", "df", "many")]
    j = pairs.groupBy("entity", "term", "class").agg(F.count(F.lit(1)).alias("n"), *own)
    j = j.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("apart"), *own)
    copies, k = F.col("both") - F.col("apart"), F.col("apart")
    n, e, t = [(x - copies).cast("double") for x in (F.lit(max(n_texts, 2)), F.col("df_e"), F.greatest("df", "both"))]
    information = F.log2(n / e)
    share = F.when((information > 0) & (k >= support), F.log2(n * k / (t * e)) / information)
    level = F.least(F.greatest(evidence(k, e, t / n), evidence(k, t, e / n)) * 10, F.lit(float(LEVELS))).cast("int")
    j = stages.write(j.select("entity", "term", "both", "many", share.alias("share"), level.alias("level")), "weighed")
    counts = j.where(F.col("share") >= generalise).groupBy("level").agg(F.sum("many")).collect()
    sure = F.col("level") >= least_level([tuple(r) for r in counts], tests, false_share)
    share = F.when(sure, F.col("share"))
    return j.select("entity", "term", "both", F.when(share >= remove, "remove").when(share >= generalise, "generalise").alias("action"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of `docs`: (id, tid, the four arrays of base spans, terms).

    `terms` has structs (start, end, action). A null or empty text has no
    spans; texts of any length are read as a whole. Ids may be null or
    repeat, and equal texts get equal results. An empty table gives an empty
    result; other columns, whatever their names, are ignored. Only entities
    and terms of fewer than `support` texts, and pairs whose term is too
    frequent for the lower threshold, go before pairs are counted: they
    cannot reach it. Entities that stand in the same texts have the same
    counts and are counted as one, and so are terms: a text with a long list
    of addresses does not pair each of them with each of its words.
    """
    stages = Stages(docs.sparkSession, "pii")
    rows = with_entities(docs, id_col, text_col)
    found = stages.write(rows.select("id", "tid", *KINDS, F.when(F.greatest(*[F.size(k) for k in KINDS]) > 0, F.col("t")).alias("t")), "entities")
    copies = stages.write(found.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    n_texts = found.count() - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    whole = stages.write(found.where("t is not null").drop("id").dropDuplicates(["tid"]), "whole")
    entities = stages.write(_entities(whole), "held")
    held = stages.write(_same_texts(entities, "entity", "df_e").where(F.col("df_e") >= support), "entity_counts")
    n_held, widest = held.agg(F.count(F.lit(1)), F.max(most_df(F.col("df_e"), n_texts, generalise))).first()
    alike = held.groupBy("xa", "xb", "df_e").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("many"))
    linked = _joined(entities, stages.write(alike.select("entity", "df_e", "many"), "entity_sets"), ["entity"], "df_e")
    linked = stages.write(linked, "linked")
    texts = whole.select("tid", "t").join(linked.select("tid").distinct(), "tid", "left_semi")
    texts = stages.write(texts.select("tid", "t", _bands(F.col("t")).alias("bands")), "texts")
    classed = stages.write(linked.join(near_copies(texts.select("tid", "bands"), stages), "tid"), "classed")
    frequency = stages.write(document_frequency(docs, copies, text_col).where(F.col("df") >= support), "frequency")
    tests = float(n_held) * frequency.count()
    terms = stages.write(_terms(texts), "terms")
    counts = _same_texts(terms, "term", "n").join(frequency, "term").where(F.col("df") <= (widest or 0.0))
    counts = stages.write(counts, "term_counts")
    sets = stages.write(counts.groupBy("xa", "xb", "n", "df").agg(F.min("term").alias("term")), "term_sets")
    members = counts.alias("c").join(sets.withColumnRenamed("term", "first"), ["xa", "xb", "n", "df"]).select("first", "term")
    members = stages.write(members, "members")
    pairs = _joined(terms, sets.select("term", "n", "df"), ["term"], "n").drop("n").join(classed, "tid")
    pairs = stages.write(pairs.where(F.col("df") <= most_df(F.col("df_e"), n_texts, generalise)), "pairs")
    counted = stages.write(disclosing(pairs, n_texts, tests, stages, support, generalise, remove, false_share), "revealing")
    hits = _joined(pairs.select("tid", "entity", "term"), counted, ["entity", "term"], "both", F.col("action").isNotNull())
    hits = hits.groupBy("tid", "term").agg(F.max(F.col("action") == "remove").alias("gone")).withColumnRenamed("term", "first").join(members, "first")
    marks = hits.groupBy("tid").agg(F.collect_set("term").alias("revealing"), F.collect_set(F.when(F.col("gone"), F.col("term"))).alias("removed"))
    t = F.col("t")
    spans = located(t, TERM, matches(t, TERM), lambda m: F.array_contains("revealing", F.lower(m)))
    action = lambda s: F.when(F.array_contains("removed", F.lower(s["value"])), "remove").otherwise("generalise")
    per_text = texts.join(marks, "tid").select("tid", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), action(s).alias("action"))).alias("terms"))
    per_text = stages.write(per_text, "spans")
    stages.keep_only("entities", "spans")
    out = found.drop("t").join(per_text, "tid", "left").select("id", "tid", *KINDS, "terms")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")))


def base_spans() -> Column:
    return F.concat(*[named(F.col(k), k) for k in KINDS])


def all_spans() -> Column:
    def of(action: str) -> Column:
        return named(F.filter("terms", lambda s: s["action"] == action), action)

    return F.concat(base_spans(), *[of(a) for a in TERM_KINDS])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """`docs` with a column `sanitised`: entities as [KIND], generalised terms as [TERM], removed terms cut.

    Of overlapping spans the one that starts first stays, then the longer. A
    null text gives an empty one; a column `sanitised` that `docs` has is
    replaced; other columns and the odd cases are as in find.
    """
    docs = without(docs, "sanitised")
    found = find(docs, id_col, text_col, **thresholds)

    def mark(c: str, put) -> Column:
        return F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), put(s).alias("put")))

    def label(kind: str):
        return lambda s: F.lit(f"[{kind.upper()}]")

    parts = [mark(k, label(k)) for k in KINDS]
    parts.append(mark("terms", lambda s: F.when(s["action"] == "remove", "").otherwise("[TERM]")))
    marks = found.select(F.col("tid").alias("_webtel_tid"), F.array_sort(F.concat(*parts)).alias("_webtel_marks")).where("size(_webtel_marks) > 0").dropDuplicates(["_webtel_tid"])
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def step(acc, m):
        free = m["start"] >= acc["at"]
        text = F.concat(acc["out"], F.substring(t, acc["at"] + 1, m["start"] - acc["at"]), m["put"])
        return F.struct(F.when(free, -m["neg"]).otherwise(acc["at"]).alias("at"), F.when(free, text).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_webtel_marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    keyed = docs.withColumn("_webtel_tid", text_key(t))
    return keyed.join(marks, "_webtel_tid", "left").withColumn("sanitised", F.coalesce(done, t)).drop("_webtel_tid", "_webtel_marks")
