"""Secret scans: base patterns, and a battery of randomness tests.

Long tokens are candidates, and the long parts of those with separators. The
alphabet of a token gives its encoding; letters only may be of an alphabet of
letters or of a wider one. Within it a battery asks how far the token is from
random: chi-squared for the uniform use of the alphabet, the number of runs
above and below its middle, the correlation of neighbours, and the
likelihood of its pairs of letters in words against chance. The root of the
sum of squares is the token's distance from random.

That distance is held against ordinary tokens: a chain of characters, with
the transition counts of all short words of all texts, spells words that are
joined in the ways of identifiers. Their distances in each encoding and
class of lengths are the null distribution, and a token's p is the chance
that an ordinary one looks as random. In each class of lengths the procedure
of Benjamini and Hochberg then bounds the share of ordinary tokens among
those that are reported. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtel.llm.common import small_side
from webtel.llm.spans import located, matches, named
from webtel.session import Stages

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Kind -> (pattern, the test of a match). The lengths of access and hex are in their patterns.
PATTERNS = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
    "access": (ACCESS, lambda m: F.lit(True)),
    "hex": (HEX, lambda m: F.lit(True)),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Parts of a candidate: base64url between / and +, base64 between - and _, letters and digits between any of them.
PARTS = tuple(rf"[A-Za-z0-9{x}]{{16,}}+={{0,2}}" for x in ("_-", "+/", ""))
_D, _U, _L = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding -> (its tokens, its alphabet); the first that fits is inferred.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _D + "abcdef"),
    "HEX": ("^[0-9A-F]+$", _D + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", _U + "234567"),
    "upper36": ("^[A-Z0-9]+$", _D + _U),
    "lower36": ("^[a-z0-9]+$", _D + _L),
    "base62": ("^[A-Za-z0-9]+$", _D + _U + _L),
    "base64": ("^[A-Za-z0-9+/]+$", _U + _L + _D + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", _U + _L + _D + "-_"),
}
#: Alphabets of letters only, tested besides the wider one; digits only are tested as such.
LETTERS = {
    "lower26": ("^[a-z]+$", _L),
    "upper26": ("^[A-Z]+$", _U),
    "letters52": ("^[A-Za-z]+$", _U + _L),
}
ENCODINGS = {"digits": ("^[0-9]+$", _D)} | ENCODINGS
#: False discovery rate; share of random tokens that the battery may refuse; least information of a secret.
RATE, REFUSE, LEAST_BITS = 0.05, 0.03, 80.0
#: p-values are counted in steps of exp(-1 / STEPS), down to exp(-BINS / STEPS).
STEPS, BINS = 20, 800
#: Least lengths of the classes of lengths.
LENGTHS = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128)
#: Ordinary tokens of each way of joining and class of lengths; least number of an encoding's that make a null distribution.
ORDINARY, LEAST_NULL = 200, 40
CHARACTERS = _D + _U + _L
#: A word, and the letters of an alphabet that have no part in words, to show how ordinary hexadecimal and decimal tokens repeat.
_FOLD = {16: "0123456789abcdef", 10: _D}


def _doubles(values: list[float]) -> str:
    return f"array({','.join(f'{v!r}D' for v in values)})"


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation that is right to about 0.0002."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _cube_root_normal(x: Column, df: Column) -> Column:
    """Wilson and Hilferty's normal value of a chi-squared one."""
    v = 2 / (9 * df)
    return (F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)


def transitions(docs: DataFrame, text_col: str = "text") -> list[list[float]]:
    """Counts of each character of CHARACTERS, and of a word's end (the last index), after each and after a word's beginning.

    From all words of fewer than 16 letters and digits in all texts, and longer
    ones of letters that stand there five times or more; 63 * 63 numbers.
    """
    words = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "[^A-Za-z0-9]+")).alias("w")).where("w <> ''")
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where((F.length("w") < 16) | (F.col("c") >= 5) & (F.length("w") < 40) & F.col("w").rlike("^[A-Za-z]+$"))
    words = words.withColumn("x", F.concat(F.lit(" "), "w", F.lit(" ")))
    pairs = words.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring(F.col("x"), i, F.lit(2)))).alias("ab"))
    at = {c: i for i, c in enumerate(CHARACTERS + " ")}
    counts = [[0.0] * len(at) for _ in at]
    for r in pairs.groupBy("ab").agg(F.sum("c").alias("c")).collect():
        counts[at[r.ab[0]]][at[r.ab[1]]] += r.c
    return counts


def letter_pairs(counts: list[list[float]]) -> list[float]:
    """For each pair of letters, whatever their case, the log of how much likelier the second is after the first in words than by chance."""
    seen = [[1.0] * 26 for _ in range(26)]
    for a, row in enumerate(counts[:62]):
        for b, c in enumerate(row[:62]):
            if a >= 10 and b >= 10:
                seen[(a - 10) % 26][(b - 10) % 26] += c
    return [math.log(26 * c / sum(row)) for row in seen for c in row]


def ordinary_tokens(spark: SparkSession, counts: list[list[float]], n: int = ORDINARY) -> DataFrame:
    """(value): words spelled by the chain of `counts`, joined as they are, in lower or upper case, by capitals, by _ - or /, or folded on few digits; of each least length."""
    cumulative = []
    for row in counts:
        row = [c + 0.01 for c in row]
        total, run = sum(row), 0.0
        cumulative.append([(run := run + c) / total for c in row][:-1])
    longest, chain = max(LENGTHS), F.expr(f"array({','.join(map(_doubles, cumulative))})")

    def step(acc, i):
        u = F.pmod(F.xxhash64("id", i, F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        k = F.size(F.filter(F.element_at(chain, acc["k"] + 1), lambda c: c <= u))
        return F.struct(k.alias("k"), F.concat(acc["x"], F.substring(F.lit(CHARACTERS + " "), k + 1, F.lit(1))).alias("x"))

    start = F.struct(F.lit(len(CHARACTERS)).alias("k"), F.lit("").alias("x"))
    spelled = spark.range(0, n, 1, 8).withColumn("x", F.aggregate(F.sequence(F.lit(1), F.lit(2 * longest)), start, step, lambda a: F.trim(F.regexp_replace(a["x"], " +", " "))))
    x, joined = F.col("x"), lambda c, by: F.replace(c, F.lit(" "), F.lit(by))
    hexa = F.translate(F.lower(joined(x, "")), CHARACTERS, "".join(_FOLD[16][i % 16] for i in range(62)))
    ways = [joined(x, ""), joined(F.lower(x), ""), joined(F.upper(x), ""), joined(F.initcap(x), ""), joined(F.lower(x), "_"), joined(F.lower(x), "-"), joined(x, "/")]
    ways += [hexa, F.upper(hexa), F.translate(joined(x, ""), CHARACTERS, "".join(_FOLD[10][i % 10] for i in range(62)))]
    each = spelled.select(F.explode(F.array(*ways)).alias("v"))
    cut = each.select("v", F.explode(F.array(*[F.lit(k) for k in LENGTHS])).alias("k")).where(F.length("v") >= F.col("k"))
    return cut.select(F.substring("v", F.lit(1), F.col("k")).alias("value"))


def random_tokens(spark: SparkSession, n: int = ORDINARY) -> DataFrame:
    """(value): tokens of each alphabet and least length whose characters are drawn by a hash."""
    alphabets = F.array(*[F.lit(a) for _, a in (ENCODINGS | LETTERS).values()])
    each = spark.range(0, n, 1, 8).select("id", F.explode(alphabets).alias("a"))
    each = each.select("id", "a", F.explode(F.array(*[F.lit(k) for k in LENGTHS])).alias("k"))
    drawn = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.substring("a", F.pmod(F.xxhash64("id", "a", "k", i), F.length("a")).cast("int") + 1, F.lit(1)))
    return each.select(F.array_join(drawn, "").alias("value"))


def unlike_random(core: Column, model: list[float]) -> Column:
    """How many standard deviations the pairs of neighbouring letters are likelier in words than random ones; 0 if less or none."""
    mean = sum(model) / len(model)
    var = sum((x - mean) ** 2 for x in model) / len(model)
    if var == 0:
        return F.lit(0.0)
    known = F.expr(_doubles(model))

    def step(acc, c):
        here = F.instr(F.lit(_L), c) - 1
        pair = (acc["last"] >= 0) & (here >= 0)
        score = F.when(pair, acc["score"] + F.element_at(known, acc["last"] * 26 + here + 1) - F.lit(mean)).otherwise(acc["score"])
        return F.struct(here.alias("last"), score.alias("score"), (acc["n"] + pair.cast("int")).alias("n"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("score"), F.lit(0).alias("n"))
    z = lambda a: F.when(a["n"] > 0, F.greatest(a["score"] / F.sqrt(a["n"] * F.lit(var)), F.lit(0.0))).otherwise(0.0)
    return F.aggregate(F.split(F.lower(core), ""), start, step, z)


def _sums(code: Column, k: Column) -> Column:
    """One pass over the places of a token's characters in its alphabet of k: what runs and correlation are made of."""

    def step(acc, c):
        up = c >= k / 2
        first = acc["last"].isNull()
        return F.struct(
            c.alias("last"),
            (acc["s"] + c).alias("s"),
            (acc["ss"] + c * c).alias("ss"),
            F.when(first, 0.0).otherwise(acc["lag"] + acc["last"] * c).alias("lag"),
            (acc["n1"] + up.cast("int")).alias("n1"),
            F.when(first, 1).otherwise(acc["runs"] + ((acc["last"] >= k / 2) != up).cast("int")).alias("runs"),
            F.coalesce(acc["first"], c).alias("first"),
        )

    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    start = F.struct(none.alias("last"), zero.alias("s"), zero.alias("ss"), zero.alias("lag"), F.lit(0).alias("n1"), F.lit(0).alias("runs"), none.alias("first"))
    return F.aggregate(code, start, step)


def battery(tokens: DataFrame, model: list[float]) -> DataFrame:
    """Adds encoding, class, bits and distance (from random) to rows with a column `value`: a row for each encoding; tokens of none go."""
    core = F.regexp_replace("value", "=+$", "")
    known = lambda e: F.coalesce(*[F.when(core.rlike(p), F.struct(F.lit(k).alias("encoding"), F.lit(a).alias("alphabet"), F.lit(float(len(a))).alias("k"))) for k, (p, a) in e.items()])
    t = tokens.withColumn("core", core).withColumn("e", F.explode(F.array_compact(F.array(known(ENCODINGS), known(LETTERS)))))
    code = F.transform(F.split("core", ""), lambda c: F.instr(F.col("e.alphabet"), c).cast("double") - 1)
    t = t.select("*", _sums(code, F.col("e.k")).alias("x"), F.length("core").cast("double").alias("n"), F.col("e.k").alias("k"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    squares = F.transform(F.split("e.alphabet", ""), lambda c: F.pow(F.length("core") - F.length(F.replace(F.col("core"), c, F.lit(""))), F.lit(2.0)))
    n, k, x = F.col("n"), F.col("k"), F.col("x")
    chi = total(squares) * k / n - n
    mu = 2 * x["n1"] * (n - x["n1"]) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    runs = F.when(var > 0, (x["runs"] - mu) / F.sqrt(var)).otherwise(F.sqrt(n))
    mean = x["s"] / n
    spread = x["ss"] - n * mean * mean
    lagged = x["lag"] - mean * (2 * x["s"] - x["first"] - x["last"]) + (n - 1) * mean * mean
    serial = F.when(spread > 1e-9, lagged / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    words = F.when(F.col("e.encoding").isin("hex", "HEX", "digits"), 0.0).otherwise(unlike_random(F.col("core"), model))
    parts = [F.greatest(_cube_root_normal(chi, k - 1), F.lit(0.0)), runs, serial, words]
    t = t.select(*tokens.columns, "e.encoding", "n", "k", *[c.alias(f"z{i}") for i, c in enumerate(parts)])
    distance = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(len(parts))), F.lit(0.0)))
    least = F.coalesce(*[F.when(n >= m, m) for m in reversed(LENGTHS)])
    return t.select(*tokens.columns, "encoding", least.alias("class"), (n * F.log2(k)).alias("bits"), distance.alias("distance"))


def null_distributions(spark: SparkSession, counts: list[list[float]], model: list[float], refuse: float = REFUSE) -> DataFrame:
    """(encoding, class, mean, sd, most): mean and deviation of the distances of ordinary tokens, and what random ones exceed with chance `refuse` only.

    One row for each of the fixed encodings and classes of lengths.
    """
    both = ordinary_tokens(spark, counts).withColumn("plain", F.lit(True)).unionByName(random_tokens(spark).withColumn("plain", F.lit(False)))
    plain, random = F.when(F.col("plain"), F.col("distance")), F.when(~F.col("plain"), F.col("distance"))
    null = battery(both, model).groupBy("encoding", "class").agg(F.avg(plain).alias("mean"), F.stddev(plain).alias("sd"), F.count(plain).alias("c"), F.percentile(random, 1 - refuse).alias("most"))
    return null.where((F.col("c") >= LEAST_NULL) & F.col("most").isNotNull()).drop("c")


def reported(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(class, stop): in each class of lengths, the first bin of p-values that is reported.

    By Benjamini and Hochberg: the largest p with p <= rate * (tokens of at
    most p) / (tokens). It needs only the counts of a fixed number of bins in
    each class of lengths.
    """
    counts = tested.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("c"))
    per = Window.partitionBy("class")
    ranked = counts.withColumn("m", F.sum("c").over(per)).withColumn("below", F.sum("c").over(per.orderBy(F.desc("bin"))))
    ok = F.exp(-F.col("bin") / F.lit(float(STEPS))) <= F.lit(rate) * F.col("below") / F.col("m")
    return ranked.groupBy("class").agg(F.coalesce(F.min(F.when(ok, F.col("bin"))), F.lit(BINS + 1)).alias("stop"))


def with_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, assign, access, hex, tokens): a row for each row of `docs`, with arrays of located spans."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    base = base.withColumn("rid", F.struct("id", F.xxhash64("id", "t").alias("hash")))
    t = F.col("t")
    found = base.select("*", *[matches(t, p).alias(f"m_{k}") for k, (p, _) in PATTERNS.items()], matches(t, CANDIDATE).alias("m_tokens"))
    spans = [located(t, p, F.col(f"m_{k}"), keep).alias(k) for k, (p, keep) in PATTERNS.items()]
    return found.select("id", "rid", *spans, located(t, CANDIDATE, F.col("m_tokens"), lambda m: F.lit(True)).alias("tokens"))


def with_parts(tokens: DataFrame) -> DataFrame:
    """`tokens` (rid, start, end, value), and the parts of those with separators."""
    v = F.col("value")
    parts = F.concat(*[located(v, p, matches(v, p), lambda m: F.lit(True)) for p in PARTS])
    cut = tokens.where(v.rlike("[+/_-]")).select("rid", F.col("start").alias("at"), F.explode(parts).alias("s"))
    cut = cut.select("rid", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), F.col("s.value").alias("value"))
    return tokens.unionByName(cut).distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, least_bits: float = LEAST_BITS) -> DataFrame:
    """One row per row of `docs`: (id, rid, assign, access, hex, random), arrays of located spans.

    Tokens that a base span covers are not tested; of spans in one another
    the outer stays. A null or empty text has no spans; texts of any length
    are read as a whole. Ids may be null or repeat; equal rows get equal
    results. An empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    stages = Stages(docs.sparkSession, "secrets")
    found = stages.write(with_base(docs, id_col, text_col), "found")
    known = F.concat(*[F.col(k) for k in KINDS])
    clear = F.filter("tokens", lambda x: ~F.exists(known, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    tokens = found.where("size(tokens) > 0").select("rid", F.explode(clear).alias("s")).select("rid", "s.*")
    counts = transitions(docs, text_col)
    model = letter_pairs(counts)
    null = stages.write(null_distributions(docs.sparkSession, counts, model), "null")
    # Two rows a token at most; without a null distribution of its encoding and class it is not reported.
    tested = battery(with_parts(tokens), model).where(F.col("bits") >= least_bits).join(F.broadcast(null), ["encoding", "class"])
    p = F.when(F.col("distance") <= F.col("most"), _normal_tail((F.col("mean") - F.col("distance")) / F.greatest("sd", F.lit(1e-3)))).otherwise(1.0)
    tested = tested.groupBy("rid", "start", "end", "value").agg(F.min(p).alias("p"), F.count(F.lit(1)).alias("tries"), F.first("class").alias("class"))
    p = F.greatest(F.least(F.col("p") * F.col("tries"), F.lit(1.0)), F.lit(1e-300))
    tested = tested.withColumn("bin", F.least(F.floor(-F.log(p) * STEPS), F.lit(BINS)).cast("int"))
    tested = stages.write(tested, "tested")
    # One row for each class of lengths.
    kept = tested.join(F.broadcast(reported(tested, rate)), "class").where("bin >= stop")
    per_doc = kept.groupBy("rid").agg(F.collect_list(F.struct("start", "end", "value")).alias("random"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    outer = F.filter("random", lambda x: ~F.exists("random", lambda y: inside(x, y)))
    per_doc = per_doc.select("rid", F.array_sort(outer).alias("random"))
    per_doc = stages.write(per_doc, "random")
    stages.keep_only("found", "random")
    out = found.drop("tokens").join(per_doc, "rid", "left")
    return out.withColumn("random", F.coalesce("random", F.array().cast("array<struct<start:int,end:int,value:string>>")))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these kinds, by start and then kind."""

    def of(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("x")))

    keyed = [of(i, k) for i, k in enumerate(kinds)]
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*keyed)), lambda s: s["x"]))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in the texts replaced by `mark`; other columns and texts stay as they are."""
    found = find(docs, id_col, text_col)
    spans = F.array_sort(F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in (*KINDS, "random")]))
    marks = found.select(F.col("rid").alias("_webtel_rid"), spans.alias("_webtel_marks")).where("size(_webtel_marks) > 0").dropDuplicates(["_webtel_rid"])
    marks = small_side(Stages(docs.sparkSession, "secrets-marks").write(marks, "marks"), 64, "_webtel_marks", 16)
    text = F.col(text_col).cast("string")
    t = F.coalesce(text, F.lit(""))

    def step(acc, m):
        gap = F.substring(t, acc["at"] + 1, m["start"] - acc["at"])
        free = m["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(free, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_webtel_marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    own_id = F.col(id_col).cast("long")
    joined = docs.withColumn("_webtel_rid", F.struct(own_id.alias("id"), F.xxhash64(own_id, t).alias("hash"))).join(marks, "_webtel_rid", "left")
    return joined.withColumn(text_col, F.when(F.col("_webtel_marks").isNull(), text).otherwise(done)).select(*[f"`{c}`" for c in docs.columns])
