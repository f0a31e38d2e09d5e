"""Registrable domains by a table of public suffix rules, with wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.functions.urls import is_ipv4


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, private) of a public suffix list in its usual text form; comments and empty lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.instr("value", "===BEGIN PRIVATE DOMAINS===").alias("mark"), "value")
    before = F.when(F.col("mark") > 0, F.size(F.split(F.substring(F.col("value"), F.lit(1), F.col("mark")), "\n")))
    rule = F.lower(F.substring_index(F.trim(F.regexp_replace("line", r"[\t\r]", " ")), " ", 1))
    rules = lines.select(rule.alias("rule"), F.coalesce(F.col("at") >= before, F.lit(False)).alias("private"))
    return rules.where((F.col("rule") != "") & ~F.startswith(F.col("rule"), F.lit("//"))).distinct()


def with_domain(df: DataFrame, host: str, rules: DataFrame, private: bool = True) -> DataFrame:
    """`df` with `suffix` and `domain`, the suffix and one more label; null for addresses, null and empty hosts, domain also for bare suffixes.

    Rules are rows (rule, private). Each distinct host is exploded into its
    suffixes, and each suffix into the three rules that could name it: itself,
    a wildcard for its first label, an exception. These are joined by
    equality, so that cost does not grow with the number of rules, which
    Spark broadcasts below its threshold. An exception wins, and its suffix is
    what stands behind its first label; else the longest rule; without any
    the last label is the suffix. A trailing dot does not count; letters of a
    host are compared in lower case.
    """
    used = (rules if private else rules.where(~F.col("private"))).select(F.lower("rule").alias("_rule")).distinct()
    h = F.lower(F.regexp_replace(F.col(host), r"\.$", ""))
    hosts = df.select(F.col(host).alias("_host")).where(F.col(host).isNotNull() & (h != "") & ~is_ipv4(F.col(host)) & ~F.contains(F.col(host), F.lit(":"))).distinct()
    labels = F.split(F.lower(F.regexp_replace("_host", r"\.$", "")), r"\.")
    parts = hosts.select("_host", F.size(labels).alias("_n"), F.posexplode(F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("_at", "_suffix"))
    behind = F.regexp_extract("_suffix", r"^[^.]*\.(.*)$", 1)
    length = F.col("_n") - F.col("_at")
    candidates = F.array(
        F.struct(F.col("_suffix").alias("_rule"), F.lit(0).alias("_exception"), length.alias("_length")),
        F.struct(F.concat(F.lit("*."), behind).alias("_rule"), F.lit(0).alias("_exception"), length.alias("_length")),
        F.struct(F.concat(F.lit("!"), "_suffix").alias("_rule"), F.lit(1).alias("_exception"), (length - 1).alias("_length")),
    )
    tried = parts.select("_host", "_n", F.explode(candidates).alias("c")).select("_host", "_n", "c.*")
    found = tried.join(used, "_rule", "left_semi").groupBy("_host").agg(F.max(F.struct("_exception", "_length")).alias("_best"))
    best = hosts.join(found, "_host", "left").select("_host", F.coalesce("_best._length", F.lit(1)).alias("_k"))
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    named = best.select("_host", last(F.col("_k")).alias("suffix"), F.when(F.size(labels) > F.col("_k"), last(F.col("_k") + 1)).alias("domain"))
    return df.join(named, F.col(host) == F.col("_host"), "left").drop("_host")
