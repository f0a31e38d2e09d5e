"""Toxicity by a weighted finite-state pattern grammar.

Tokens get a class from a lexicon (insult, threat, target, negation, report,
clause end). Two transducers read the classes: one follows the scope of
negation and of reported speech, the other composes insults and threats with
their targets. Their composition is one table; each match is an event with
the weight of its word. The events of a document's clauses give its score.

The lexicon has a fixed core and words or word beginnings learned from
labelled documents: those whose log odds of standing in a toxic document are
high with confidence. The weights of the events are a logistic regression
around prior weights, fitted on the other half of the labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import release_held, small_batches, without

#: Labelled rows that are fitted on, about; all are used if there are fewer.
FIT_ROWS = 40_000
#: Terms that a lexicon may learn.
LEXICON_TERMS = 20_000
PREFIXES = (4, 5, 6, 7)
#: Terms that a task counts before it hands them on; Spark adds up what is handed on more than once.
HELD_TERMS = 100_000

INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(1, 7)
OTHER = 0
#: The core lexicon in four languages.
CORE = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown dumb imbecile idiota imbécil estúpido estúpida basura dummkopf trottel abschaum widerlich wertlos crétin crétine abruti ordure nul minable",
    THREAT: "kill hurt destroy beat shoot stab töten umbringen vernichten schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself du dich dir dein deine euch ihr tu toi ton vous votre tú ti tus usted ustedes vosotros they them he she",
    NEGATION: "not no never isn't aren't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    REPORT: "said says say called calls wrote writes quoted quote claimed reported sagte schrieb nannte behauptete dit écrit appelé dijo escribió llamó",
}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")

PLAIN, NEGATED, REPORTED = range(3)
KINDS = ("insult", "targeted insult", "threat", "targeted threat")
#: Weights of the events before anything is learned: for each kind plain, negated, reported; then the strongest clause.
PRIOR = np.array([-3.0, 3, 1, 1, 4, 1.5, 1.5, 2, 0.5, 0.5, 4, 1, 1, 2])
FEATURES = len(PRIOR) - 1


class Scope:
    """Reads negations (they reach over three more tokens) and reporting verbs (to the end of the clause)."""

    start = ("plain", 0)

    @staticmethod
    def step(state, kind):
        name, left = state
        if kind == END:
            return Scope.start, PLAIN
        if name == "reported" or kind == REPORT:
            return ("reported", 0), REPORTED
        if kind == NEGATION:
            return ("negated", 3), NEGATED
        if name == "negated" and left:
            return (("negated", left - 1) if left > 1 else Scope.start), NEGATED
        return Scope.start, PLAIN


class Pattern:
    """Joins insults and threats with a target before or after them in the clause."""

    start = "none"

    @staticmethod
    def step(state, kind):
        if kind == END:
            return Pattern.start, None
        if kind in (INSULT, THREAT):
            plain = 0 if kind == INSULT else 2
            if state == "target":
                return state, plain + 1
            return ("insult" if kind == INSULT else "threat"), plain
        if kind == TARGET:
            late = {"insult": 1, "threat": 3}.get(state)
            return "target", late
        return state, None


def compose(first=Scope, second=Pattern) -> tuple[dict, tuple]:
    """Table (state, class) -> (next state, feature or None) of both transducers run together."""
    start = (first.start, second.start)
    table, todo = {}, [start]
    while todo:
        s = todo.pop()
        if (s, OTHER) in table:
            continue
        for kind in range(7):
            a, mode = first.step(s[0], kind)
            b, event = second.step(s[1], kind)
            table[s, kind] = ((a, b), None if event is None else 3 * event + mode)
            todo.append((a, b))
    return table, start


class Lexicon(dict):
    """Token -> (class, weight), or None for other tokens; remembers tokens it has seen."""

    def __init__(self, learned: dict[str, float], most: int = 300_000):
        super().__init__()
        self.learned, self.most = learned, most
        self.core = {w: k for k, ws in CORE.items() for w in ws.split()} | dict.fromkeys(".!?;\n", END)

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
        kind = self.core.get(token, OTHER)
        weight = max((self.learned.get(t, 0.0) for t in terms(token)), default=0.0)
        if kind in (OTHER, INSULT) and weight:
            got = (INSULT, weight)
        else:
            got = (kind, 0.5 if kind in (INSULT, THREAT) else 0.0) if kind else None
        self[token] = got
        return got


def terms(token: str) -> list[str]:
    """What is learned of a token: itself, and beginnings of it marked by a star."""
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)]


class Grammar:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.table, self.start = compose()

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(FEATURES)
        got = [self.lexicon[t] for t in _TOKEN.findall(text.lower())]
        if not any(g and g[0] in (INSULT, THREAT) for g in got):
            return x
        state, held, clause = self.start, 0.0, 0.0
        for g in got:
            kind, weight = g or (OTHER, 0.0)
            state, event = self.table[state, kind]
            held = weight or held
            if event is not None:
                x[event] += held
                clause += held * max(PRIOR[1 + event], 0)
            if kind == END:
                x[-1] = max(x[-1], clause)
                clause = 0.0
        x[-1] = max(x[-1], clause)
        return np.log1p(x)


def _count_terms(batches):
    """Documents with each term: toxic and clean ones, of the first half and of all."""
    release_held()
    counts: dict[str, list[int]] = {}

    def flush():
        keys, rows = list(counts), np.array(list(counts.values()), dtype=np.int64).reshape(-1, 4)
        counts.clear()
        for i in range(0, len(keys), 50_000):
            r = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.string()), *[pa.array(r[:, k]) for k in range(4)]], ["term", "tox_a", "clean_a", "tox", "clean"])

    for b in batches:
        for t, toxic, half in zip(b.column("t").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
            seen = {x for w in set(_TOKEN.findall((t or "").lower())) if len(w) > 2 for x in terms(w)}
            for term in (*seen, ""):
                c = counts.get(term)
                if c is None:
                    c = counts[term] = [0, 0, 0, 0]
                c[2 + (not toxic)] += 1
                if half == 0:
                    c[not toxic] += 1
        if len(counts) > HELD_TERMS:
            yield from flush()
    yield from flush()


def _confident_log_odds(tox: str, clean: str, n_tox: int, n_clean: int) -> Column:
    a, c = F.col(tox) + 0.5, F.col(clean) + 0.5
    x, y = F.lit(n_tox) - F.col(tox) + 0.5, F.lit(n_clean) - F.col(clean) + 0.5
    return F.log(a / x) - F.log(c / y) - 2 * F.sqrt(1 / a + 1 / c + 1 / x + 1 / y)


def _top_terms(counts: DataFrame, tox: str, clean: str, n_tox: int, n_clean: int, support: int = 5, share: float = 0.004, least: float = 2.0) -> dict[str, float]:
    """Terms of enough toxic documents (a number and a share of them, since copies repeat words) and high confident log odds."""
    if not n_tox or not n_clean:
        return {}
    scored = counts.where(F.col(tox) >= max(support, share * n_tox)).select("term", F.col(tox).alias("n"), _confident_log_odds(tox, clean, n_tox, n_clean).alias("w"))
    rows = scored.where((F.col("w") > least) & (F.col("term") != "")).orderBy(F.desc("w"), "term").limit(LEXICON_TERMS).collect()
    # A beginning that nearly always begins one and the same word says nothing of other words.
    single: dict[str, int] = {}
    for r in rows:
        for t in terms(r.term)[1:] if not r.term.endswith("*") else ():
            single[t] = max(single.get(t, 0), r.n)
    return {r.term: min(r.w, 6.0) / 6.0 for r in rows if single.get(r.term, 0) < 0.6 * r.n}


def _regression(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a Gaussian prior around PRIOR, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    pull = np.full(len(w), strength)
    pull[0] = 1e-3

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * pull @ (w - PRIOR) ** 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - PRIOR))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, learned: dict[str, float], weights: np.ndarray):
        self.learned, self.weights = learned, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(c: Column) -> Column:
    """Remainder of the CRC-32 of an id as text; 0 is held out. Null ids are in no fold."""
    return F.pmod(F.crc32(c.cast("string")), F.lit(5))


def _features(learned: dict[str, float], keep: list[str]):
    def run(batches):
        release_held()
        grammar = Grammar(Lexicon(learned))
        for b in batches:
            x = [grammar.features(t or "") for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows that are not held out; about `fit_rows` of them, chosen by a hash of the id.

    Lexicon statistics, the event table and the collected features (a few
    numbers for each fitted row) are bounded by `fit_rows` and LEXICON_TERMS.
    Without labels, the core lexicon and the prior weights remain.
    """
    small_batches(docs.sparkSession)
    known = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), "toxic")
    n = known.count()
    spread = 1 << 20
    at = F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(spread))
    known = known.where(at < int(spread * min(1.0, fit_rows / max(n, 1)))) if n > fit_rows else known
    known = known.withColumn("half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known), "_id")

    counted = rows.select("t", "toxic", "half").mapInArrow(_count_terms, "term string, tox_a long, clean_a long, tox long, clean long")
    counts = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("tox_a", "clean_a", "tox", "clean")]).where("tox >= 5 or term = ''").cache()
    total = counts.where("term = ''").first()
    if total is None:
        return Model({}, PRIOR)
    first = _top_terms(counts, "tox_a", "clean_a", total.tox_a, total.clean_a)
    learned = _top_terms(counts, "tox", "clean", total.tox, total.clean)
    counts.unpersist()
    got = rows.where("half = 1").select("t", "toxic").mapInArrow(_features(first, ["toxic"]), "toxic int, x array<double>").collect()
    if not got:
        return Model(learned, PRIOR)
    return Model(learned, _regression(np.array([r.x for r in got]), np.array([r.toxic for r in got], dtype=float)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `toxicity`, from 0 to 1 for every text, read as a whole; null and empty texts get the score of no event.

    Equal texts get equal scores and repeated rows stay; ids may be null or
    repeat; an empty table gives an empty result; a column `toxicity` that
    `docs` has is replaced.
    """
    return _scored(without(docs, "toxicity"), model, text_col, "toxicity")


def keep_below(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below `most`, with all their columns, also such as are called `toxicity`."""
    return _scored(docs, model, text_col, "_webtel_toxicity").where(F.col("_webtel_toxicity") < most).drop("_webtel_toxicity")


def _scored(docs: DataFrame, model: Model, text_col: str, out_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    keep = [f"_c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{k} {t}" for k, (_, t) in zip(keep, docs.dtypes, strict=True)) + ", toxicity double"

    def run(batches):
        for b in _features(model.learned, keep)(batches):
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(model.scores(x))], [*keep, "toxicity"])

    cols = [F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, keep, strict=True)]
    out = docs.select(*cols, F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, keep, strict=True)], F.col("toxicity").alias(out_col))
