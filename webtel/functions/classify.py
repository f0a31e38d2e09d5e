"""Strings that look like identifiers: a character bigram model estimated from text.

The model is a parameter. It holds log probabilities of neighbouring
characters over a lower-case alphabet; strings whose geometric mean
probability is low look random. The fixed tables of other implementations
are not shipped: the default model is counted from a corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.functions.text import entropy, share
from webtel.functions.urls import decode_component, let
from webtel.session import Stages

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_."
#: Shortest identifier, and the least mean probability of ordinary strings under an estimated model.
LEAST_LENGTH, THRESHOLD = 6, 0.015


def bigram_model(texts: DataFrame, column: str, smoothing: float = 1.0, alphabet: str = ALPHABET) -> np.ndarray:
    """Log probability of each character after each other; counts of all rows, one small matrix to the driver."""
    other = "[^" + "".join(sorted(alphabet.replace("-", ""))) + "-]+"
    words = texts.select(F.explode(F.split(F.lower(F.col(column)), other)).alias("w")).where(F.length("w") >= 2)
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("g"))
    rows = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()  # at most len(alphabet) ** 2 rows
    n = np.full((len(alphabet), len(alphabet)), smoothing)
    for r in rows:
        n[alphabet.index(r.g[0]), alphabet.index(r.g[1])] += r.n
    return np.log(n / n.sum(axis=1, keepdims=True))


def _table(pairs: np.ndarray) -> Column:
    """A matrix as an array column: one constant, split once when planned."""
    return F.split(F.lit(",".join(repr(float(x)) for x in np.ravel(pairs))), ",").cast("array<double>")


def mean_probability(model: np.ndarray, alphabet: str = ALPHABET) -> Callable[[Column | str], Column]:
    """A column function: geometric mean probability of the pairs of neighbouring characters that are both known; 1 without any."""
    table = _table(model)

    def score(c: Column | str) -> Column:
        def mean(x: Column) -> Column:
            at = lambda i: F.instr(F.lit(alphabet), F.substring(x, i, F.lit(1)))
            zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
            both = lambda i: (at(i) > 0) & (at(i + 1) > 0)
            add = lambda a, i: F.when(both(i), F.struct((a["sum"] + F.get(table, (at(i) - 1) * len(alphabet) + at(i + 1) - 1)).alias("sum"), (a["n"] + 1).alias("n"))).otherwise(a)
            pairs = F.aggregate(F.sequence(F.lit(1), F.length(x) - 1), zero, add, lambda a: F.when(a["n"] > 0, F.exp(a["sum"] / a["n"])).otherwise(1.0))
            return F.when(F.length(x) > 1, pairs).when(x.isNotNull(), 1.0)

        return let(F.lower(F.col(c) if isinstance(c, str) else c), mean)

    return score


def is_identifier(c: Column, probability: Column, threshold: float = THRESHOLD) -> Column:
    """Long enough, letters and digits only, and improbable; UUIDs always are, sizes and post codes never."""
    uuid = c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    plain = c.rlike("^[0-9]+$") | c.rlike("^[0-9]+x[0-9]+$") | c.rlike("(?i)^[a-z]{1,2}[0-9][0-9a-z]? ?[0-9][a-z]{2}$")
    shaped = (F.length(c) >= LEAST_LENGTH) & c.rlike("^[A-Za-z0-9]+$")
    return F.coalesce(uuid | (~plain & shaped & (probability < threshold)), F.lit(False))


def mostly_numeric(c: Column, most: float = 0.8) -> Column:
    return (F.length(c) > 0) & (F.length(F.regexp_replace(c, "[^0-9]", "")) / F.length(c) > most)


def token_candidate(c: Column, identifier: Column, now_ms: Column) -> Column:
    """Which values of a request are worth counting: long enough, no address, no time, numeric or an identifier."""
    from webtel.functions.times import is_epoch_millis
    from webtel.functions.urls import is_ipv4

    return (
        F.when(F.coalesce(F.length(c) < LEAST_LENGTH, F.lit(True)), F.lit(False))
        .when(F.length(c).between(7, 15) & is_ipv4(c), F.lit(False))
        .when((F.length(c) < 13) & mostly_numeric(c), F.lit(True))
        .when(is_epoch_millis(c, now_ms), F.lit(False))
        .otherwise(identifier)
    )


# --- identifiers by several features ----------------------------------------------------------------------------

#: Characters that the pair probabilities of the feature model know; others are passed over.
KNOWN = "abcdefghijklmnopqrstuvwxyz1234567890.- "
FEATURES = ("probability", "entropy", "hex", "vowels", "transitions")


@dataclass(frozen=True)
class IdentifierModel:
    """A logistic model over FEATURES: pair log probabilities over KNOWN, a bias, weights, and the least probability of an identifier."""

    pairs: np.ndarray
    bias: float
    weights: tuple[float, ...]
    cut: float = 0.8

    @property
    def limit(self) -> float:
        """The least sum of weighted features of an identifier."""
        return float(np.log(self.cut / (1 - self.cut)))


def pair_probability(c: Column, pairs: np.ndarray, alphabet: str = KNOWN) -> Column:
    """Geometric mean probability of neighbouring known characters, others left out; 1 for less than two."""
    table = _table(pairs)
    at = lambda x, i: F.instr(F.lit(alphabet), F.substring(x, i, F.lit(1)))

    def mean(x: Column) -> Column:
        logs = lambda i: F.get(table, (at(x, i) - 1) * len(alphabet) + at(x, i + 1) - 1)
        total = F.aggregate(F.sequence(F.lit(1), F.length(x) - 1), F.lit(0.0), lambda a, i: a + logs(i))
        return F.when(F.length(x) > 1, F.exp(total / (F.length(x) - 1))).otherwise(1.0)

    known = "[^" + "".join(sorted(alphabet.replace("-", ""))) + "-]"
    return let(F.regexp_replace(F.lower(c), known, ""), mean)


def decoded_text(c: Column) -> Column:
    """Percent-decoded where that gives a text, else as it is."""
    return F.when(c.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(decode_component(c), c)).otherwise(c)


def identifier_features(c: Column, pairs: np.ndarray) -> Column:
    """Struct of FEATURES of a text: pair probability, entropy, shares of hexadecimal digits and of vowels among letters, changes between letters and digits."""

    def of(low: Column) -> Column:
        letters = F.length(F.regexp_replace(low, "[^a-z]", ""))
        changes = F.size(F.split(F.regexp_replace(low, "[^a-z0-9]", ""), "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")) - 1
        return F.struct(
            pair_probability(low, pairs).alias("probability"),
            entropy(low).alias("entropy"),
            share(low, "[0-9a-f]").alias("hex"),
            F.when(letters > 0, F.length(F.regexp_replace(low, "[^aeiou]", "")) / letters).otherwise(0.0).alias("vowels"),
            F.when(F.length(low) > 1, changes / (F.length(low) - 1)).otherwise(0.0).alias("transitions"),
        )

    return let(F.lower(decoded_text(c)), of)


def identifier_score(c: Column, model: IdentifierModel) -> Column:
    """Probability of an identifier; 0 for short texts, numbers, sizes and post codes, 1 for UUIDs."""

    def of(x: Column) -> Column:
        uuid = x.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
        plain = x.rlike("^[0-9]+$") | x.rlike("^[0-9]+x[0-9]+$") | x.rlike("(?i)^[a-z]{1,2}[0-9][0-9a-z]?[0-9][a-z]{2}$")
        by_features = let(identifier_features(x, model.pairs), lambda f: logistic({k: f[k] for k in FEATURES}, dict(zip(FEATURES, model.weights, strict=True)), model.bias))
        return F.when((F.length(x) < LEAST_LENGTH) | plain, 0.0).when(uuid, 1.0).otherwise(by_features)

    return F.when(F.length(c) < LEAST_LENGTH, 0.0).when(c.isNotNull(), let(decoded_text(c), of))


#: Most examples, about, that a model is fitted to.
FIT_ROWS = 40_000


def fit_identifiers(examples: DataFrame, text: str, label: str, pairs: np.ndarray, cut: float = 0.8, ridge: float = 1e-3, rounds: int = 25, most: int = FIT_ROWS) -> IdentifierModel:
    """Weights by Newton's method. A round is one aggregate of the gradient's and curvature's sums over all examples.

    `label` is 1 for identifiers and 0 for ordinary texts; rows where either
    is null take no part. Six weights need no more than some ten thousand
    rows: of more than `most`, those count whose hash falls into that share.
    Their features are computed once and written. Without rows the weights
    are zero. `ridge` is a small penalty a row, which keeps weights finite
    where the classes can be told apart entirely.
    """
    stages = Stages(examples.sparkSession, "identifiers")
    rows = stages.write(examples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text), F.col(label)), "examples")
    many = rows.count()
    if many > most:
        rows = rows.where(F.pmod(F.xxhash64(text, label), F.lit(many)) < most)
    f = rows.select(identifier_features(F.col(text), pairs).alias("f"), F.col(label).cast("double").alias("y")).select(F.lit(1.0).alias("bias"), "f.*", "y")
    f = stages.write(f, "features")
    names = ("bias", *FEATURES)
    w = np.zeros(len(names))
    corner = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((F.col(k) * float(x) for k, x in zip(names, w, strict=True)), F.lit(0.0))))
        of = f.withColumn("p", p).withColumn("r", F.col("p") - F.col("y")).withColumn("v", F.col("p") * (1 - F.col("p")))
        sums = of.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("r") * F.col(k)).alias(f"g{i}") for i, k in enumerate(names)], *[F.sum(F.col("v") * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in corner]).first()
        if not sums.n:
            break
        curve = np.zeros((len(names), len(names)))
        for i, j in corner:
            curve[i, j] = curve[j, i] = sums[f"h{i}_{j}"] / sums.n
        step = np.linalg.solve(curve + ridge * np.eye(len(names)), np.array([sums[f"g{i}"] for i in range(len(names))]) / sums.n + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    stages.keep_only()
    return IdentifierModel(pairs, float(w[0]), tuple(map(float, w[1:])), cut)


def logistic(features: dict[str, Column], weights: dict[str, float], bias: float) -> Column:
    """A logistic model over columns; the weights are parameters."""
    z = sum((c * F.lit(weights[k]) for k, c in features.items()), F.lit(bias))
    return 1 / (1 + F.exp(-z))
