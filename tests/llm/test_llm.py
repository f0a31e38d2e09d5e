"""Each operator against a brute-force version, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from webtel.llm import ann, common, embed_dedup, licenses, packing, pii, queries, secret_scan, simhash, sp_codec, substring, toxicity

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, id string, rid int, cover int, _t string"


def corpus():
    rnd = random.Random(3)
    vocab = ["The", "quick", "fox", "été", "漢字", "a.b", "x1", "GNU", "general", "public", "License", "mail@x.test", "\t", "  ", "1.2.3.4", "MIT", "license", "😀"]
    long = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (60, 90, 120, 400)]
    texts = [None, "", " ", "\n\t", "one", "one two", *long]
    texts += [long[1], long[1], long[2] + " tail", "head " + long[0] + " middle " + long[1], long[0][:200]]
    texts += [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    texts += ["z" * 20000, "7" * 5000, "é" * 3000, "a " * 20000]
    rows = list(enumerate(texts)) + [(3, texts[6]), (6, texts[6]), (None, long[0]), (None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators also use, rows that repeat, null ids and null texts."""
    return spark.createDataFrame([(i, x, "en", None, None, "t", "id", 1, 2, "_t") for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def digest(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# --- op1


def test_license_places(docs, rows):
    def brute(x):
        x = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))

    got = licenses.scan(docs).drop("labels", "score").collect()
    assert bag(got) == bag((i, *brute(x)) for i, x in rows)


def test_license_labels(spark, empty):
    texts = ["Released under the MIT License, gnu general-public license.", "Licensed under CC BY-NC 4.0.", "the license by gnu", "GNU Lesser General Public License"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("id").collect()
    assert [r.labels for r in got] == ["gpl,mit", "cc-by,cc-by-nc", "", "lgpl"]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 1 and got[2].score == 0
    assert licenses.scan(empty).count() == 0


# --- op2, op10


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def brute_pii(x):
    out = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, p in patterns.items():
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def brute_secrets(x):
    out = []
    patterns = {
        "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    for i, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, x):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


@pytest.fixture(scope="module")
def marked(spark):
    rnd = random.Random(8)
    bits = ["a", "B", "@", ".", "-", "+", "1", "23", "4532015112830366", " ", "1.2.3.4", "256", "😀", "é", "(", ")", "_", "a@b.co", "password", "token=", "api_key", ":", '"', "'", "=", "AKIA", "AB12", "deadbeef", "0123456789abcdef", "/", "Secret", "00", "+1 (222) 555-1234", "SECRET: xyz123"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 30000), (1003, "1" * 30000), (1004, "a@b" + ".c" * 10000), (1005, "1 " * 10000), (1006, "+1" + " " * 10000), (7, rows[7][1]), (None, "x a@b.co")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_pii_base(marked, empty):
    rows, df = marked
    got = pii.find(df).select("id", F.concat_ws(",", pii.base_spans())).collect()
    assert bag(got) == bag((i, ",".join(brute_pii(x or ""))) for i, x in rows)
    assert pii.find(empty).count() == 0


def test_pii_terms(spark):
    texts = ["call Zorblax at zor@blax.test now", "again Zorblax with zor@blax.test then", *[f"call the office {i} at now again then with" for i in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: r.s for r in pii.find(df).select("id", F.concat_ws(",", pii.all_spans()).alias("s")).collect()}
    assert got[0] == "email:16:29,remove:5:12" and got[1] == "email:19:32,remove:6:13" and got[5] == ""
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(df).collect()}
    assert clean[0] == "call  at [EMAIL] now" and clean[5] == texts[5]


def vocabulary(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9))) for _ in range(n)]


def brute_disclosed(rows):
    """{text: {(term, action)}} of texts that are no near copies of each other, by a loop over all pairs."""
    texts = sorted({x for _, x in rows if x})
    n = len({x or "" for _, x in rows})
    held = {x: set(re.findall(r"[a-z]+@x\.test", x)) for x in texts}
    words = {x: {w.lower() for w in re.findall("[A-Za-z]{3,}", re.sub(r"[a-z]+@x\.test", " ", x))} for x in texts}
    every = {x: {w.lower() for w in re.findall("[A-Za-z]{3,}", x)} for x in texts}
    df_e = collections.Counter(e for h in held.values() for e in h)
    df_t = collections.Counter(w for ws in every.values() for w in ws)
    both = collections.Counter((e, w) for x in texts for e in held[x] for w in words[x])

    def level(k, draws, p):
        a = k / draws
        if a <= p:
            return 0
        return int(10 * draws * (a * math.log(a / p) + (0 if a == 1 else (1 - a) * math.log((1 - a) / (1 - p)))) / math.log(10))

    found = {}
    for (e, w), k in both.items():
        if k >= 2 and n > df_e[e]:
            share = math.log2(n * k / (df_t[w] * df_e[e])) / math.log2(n / df_e[e])
            found[e, w] = share, max(level(k, df_e[e], df_t[w] / n), level(k, df_t[w], df_e[e] / n))
    tests = sum(v >= 2 for v in df_e.values()) * sum(v >= 2 for v in df_t.values())
    passed = sorted((v for s, v in found.values() if s >= 0.6), reverse=True)
    cut = min((v for v in passed if tests * 10 ** (-v / 10) <= 0.05 * sum(u >= v for u in passed)), default=math.inf)
    sure = {p: s for p, (s, v) in found.items() if v >= cut and s >= 0.6}
    out = {}
    for x in texts:
        for e in held[x]:
            for w in words[x]:
                if (e, w) in sure:
                    out.setdefault(x, {})[w] = max(out.get(x, {}).get(w, ""), "remove" if sure[e, w] >= 0.9 else "generalise")
    return {x: set(d.items()) for x, d in out.items()}


def disclosed(df):
    return {r.text: {(r.text[s.start : s.end].lower(), s.action) for s in r.terms} for r in pii.find(df).join(df, F.col("id") == F.col("doc_id")).collect() if r.terms}


def test_pii_terms_equal_a_loop_over_all_pairs(spark):
    """Names far from an address, half-revealing ones, chance words, repeated and null texts."""
    rnd = random.Random(31)
    common, rare = vocabulary(rnd, 150), vocabulary(rnd, 400)
    texts = []
    for i in range(260):
        ws = [rnd.choice(common) for _ in range(rnd.randint(40, 90))] + [rnd.choice(rare) for _ in range(3)]
        who = i % 13
        if who < 4:
            ws.append(f"{'abcd'[who]}@x.test")
            ws += ["Zeppelin", "Wolkenstein"][: rnd.randint(1, 2)] if who == 0 else ["Amsel"] if who == 1 or rnd.random() < 0.1 else []
        elif rnd.random() < 0.08:
            ws.append("Zeppelin")
        rnd.shuffle(ws)
        texts.append(" ".join(ws))
    rows = list(enumerate([*texts, *texts[:5] * 3, None, "", ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = disclosed(df), brute_disclosed(rows)
    assert got == want and {a for s in want.values() for _, a in s} == {"remove", "generalise"}
    assert {("amsel", "generalise"), ("wolkenstein", "remove"), ("zeppelin", "generalise")} <= {x for s in want.values() for x in s}


def test_signature_lines_are_found_and_chance_words_are_not(spark):
    rnd = random.Random(8)
    common, rare = vocabulary(rnd, 800), vocabulary(rnd, 3000)
    line = "yours truly as ever your colleague Marinella Delgadoz, write to me at m.d@x.org or call the front office"

    def text(put):
        ws = [rnd.choice(common) for _ in range(120)] + [rnd.choice(rare) for _ in range(8)]
        rnd.shuffle(ws)
        return " ".join([*ws[:60], put, *ws[60:]])

    texts = [text(line) for _ in range(20)] + [text(f"{rnd.choice(common)} Torvaldsen {rnd.choice(common)} t.v@x.org") for _ in range(20)]
    texts += [text("write to me or call the front office yours truly as ever your colleague") for _ in range(400)]
    got = disclosed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(got[x] == {("marinella", "remove"), ("delgadoz", "remove")} for x in texts[:20])
    assert all(got[x] == {("torvaldsen", "remove")} for x in texts[20:40]) and len(got) == 40


def test_copies_disclose_nothing(spark):
    """Neither do many near copies, each with a change of its own; names that also stand elsewhere with the entity do."""
    rnd = random.Random(15)
    words = vocabulary(rnd, 300)
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    text = f"{some(80)} Contact Maria Delgado about the budget at m.d@x.org today {some(80)}"

    def near():
        ws = text.split()
        ws[rnd.randrange(60)] = rnd.choice(words)
        return " ".join(ws)

    rest = [some(60) for _ in range(400)]
    for copies in ([text] * 3, [text, text.replace("budget", "plan", 1)], [near() for _ in range(40)]):
        df = spark.createDataFrame(list(enumerate([*copies, *rest])), "doc_id long, text string")
        assert not any(r.terms for r in pii.find(df).collect())
    apart = [f"{some(30)} Delgado wrote from m.d@x.org {some(30)}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate([*[near() for _ in range(40)], *apart, *rest])), "doc_id long, text string")
    got = disclosed(df)
    assert all(got[x] == {("delgado", "remove")} for x in apart)


def test_lists_of_addresses_count_as_one(spark):
    """Entities and terms of the same texts are counted once; all of them are reported."""
    rnd = random.Random(4)
    words = vocabulary(rnd, 300)
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    contacts = [f"{''.join(rnd.choice('abcdefgh') for _ in range(9))}@x.test" for _ in range(50)]
    names = [w.capitalize() + "ova" for w in vocabulary(rnd, 50)]
    texts = [" ".join(x for k in rnd.sample(range(50), 50) for x in (some(3), names[k], contacts[k])) for _ in range(8)]
    rows = list(enumerate([*texts, *[some(60) for _ in range(300)]]))
    got = disclosed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_disclosed(rows) and all({(w.lower(), "remove") for w in names} <= got[x] for x in texts)


def test_secrets_base(marked, empty):
    rows, df = marked
    got = secret_scan.find(df).select("id", secret_scan.listed(secret_scan.KINDS)).collect()
    assert bag(got) == bag((i, ",".join(brute_secrets(x or ""))) for i, x in rows)
    assert secret_scan.find(empty).count() == 0


def test_random_tokens(spark):
    rnd = random.Random(2)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secrets = ["".join(rnd.choice(b64) for _ in range(44)) for _ in range(10)]
    plain = ["aaaaaaaaaaaaaaaaaaaa1111111111111111111", "user-1-user-1-user-1-user-1-user-1-user-1-user-1-user-1"]
    texts = [f"see {s} here" for s in (*secrets, *plain * 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: len(r.random) for r in secret_scan.find(df).collect()}
    assert sum(got[i] for i in range(10)) >= 9 and sum(got[i] for i in range(10, 20)) == 0
    red = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert "[SECRET]" in red[0] and red[15] == texts[15]


def test_random_tokens_of_letters_and_in_paths(spark):
    rnd = random.Random(5)
    word = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    letters = [word(a, n) for a, n in ((low, 40), (low.upper(), 16), (low.upper(), 40), (low + low.upper(), 20), (low + low.upper(), 60)) for _ in range(4)]
    keys = [word(low + low.upper() + "0123456789", 40) for _ in range(10)]
    paths = [f"host/services/T01-AB/{k}" for k in keys]
    plain = ["host/services/and-a-path/of-words/and-words", "this_is_the_name_of_the_function_that_is_called", "12345678901234567890"]
    plain += ["telecommunications"]
    prose = ["the name of this host is that of the function which calls the services, and a path of words is called telecommunication"] * 100
    df = spark.createDataFrame(list(enumerate([*(f"see {s} here" for s in (*letters, *paths, *plain * 5)), *prose])), "doc_id int, text string")
    got = {r.id: [s.value for s in r.random] for r in secret_scan.find(df).collect()}
    assert sum(got[i] == [s] for i, s in enumerate(letters)) >= 18
    assert sum(any(s.endswith(k) for s in got[20 + i]) for i, k in enumerate(keys)) >= 9
    assert not any(got[i] for i in range(30, 50))


def brute_distance(v, alphabet, model, words):
    v = v.rstrip("=")
    code, n, k = [alphabet.index(c) for c in v], len(v), len(alphabet)
    cube = lambda x, df: ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    chi = max(0.0, cube(sum((n_c - n / k) ** 2 / (n / k) for n_c in (code.count(i) for i in range(k))), k - 1))
    up = [c >= k / 2 for c in code]
    mu = 2 * sum(up) * (n - sum(up)) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    runs = (1 + sum(a != b for a, b in zip(up, up[1:])) - mu) / math.sqrt(var) if var > 0 else math.sqrt(n)  # noqa: B905
    dev = np.array(code) - np.mean(code)
    serial = (dev[1:] * dev[:-1]).sum() / (dev**2).sum() * math.sqrt(n) if (dev**2).sum() > 1e-9 else math.sqrt(n)
    low = ["abcdefghijklmnopqrstuvwxyz".find(c) for c in v.lower()]
    pairs = [model[a * 26 + b] for a, b in zip(low, low[1:]) if a >= 0 and b >= 0]  # noqa: B905
    z = max(0.0, (sum(pairs) - len(pairs) * np.mean(model)) / math.sqrt(len(pairs) * np.var(model))) if words and pairs else 0.0
    return math.sqrt(chi**2 + runs**2 + serial**2 + z**2)


def test_battery(spark):
    rnd = random.Random(12)
    model = [rnd.gauss(-0.3, 1) for _ in range(676)]
    known = secret_scan.ENCODINGS | secret_scan.LETTERS
    tokens = ["".join(rnd.choice(a) for _ in range(n)) for _, a in known.values() for n in (16, 21, 40, 131)] + ["a" * 30, "0" * 20, "ab" * 10 + "==", "not a token"]
    got = secret_scan.battery(spark.createDataFrame([(t,) for t in tokens], "value string"), model).collect()
    for r in got:
        assert math.isclose(r.distance, brute_distance(r.value, known[r.encoding][1], model, r.encoding not in ("hex", "HEX", "digits")), rel_tol=1e-6, abs_tol=1e-6)
    assert {r.value for r in got} == set(tokens[:-1])


def test_false_discovery_control(spark):
    """The bins that are reported are those of the procedure on sorted p-values."""
    rnd = random.Random(13)
    rows = [(c, min(secret_scan.BINS, int(rnd.expovariate(1 / s)))) for c, s in ((16, 20), (20, 150)) for _ in range(300)]
    stop = {r["class"]: r.stop for r in secret_scan.reported(spark.createDataFrame(rows, "class int, bin int")).collect()}
    for c in (16, 20):
        bins = sorted((b for k, b in rows if k == c), reverse=True)
        good = [b for i, b in enumerate(bins, 1) if math.exp(-b / secret_scan.STEPS) <= 0.05 * sum(x >= b for x in bins) / len(bins)]
        assert {b for b in bins if b >= stop[c]} == set(good)


def test_plain_identifiers_are_no_secrets(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rnd = random.Random(14)
    b62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    secrets = ["".join(rnd.choice(b62) for _ in range(n)) for n in (20, 24, 32, 40) for _ in range(10)]
    plain = "getElementById2Foo MyVeryLongClassName3 configurationManagerImpl2 chapter12section3paragraph4 read_user_config_value handlerFactoryServiceImpl".split()
    more = spark.createDataFrame([(10**6 + i, f"see {x} here") for i, x in enumerate(secrets + plain * 6)], "doc_id long, text string")
    got = {r.id for r in secret_scan.find(d.unionByName(more)).where("size(random) > 0").collect()}
    assert sum(10**6 + i in got for i in range(40)) >= 36
    assert sum(10**6 + i in got for i in range(40, 76)) <= 2


# --- op3


def test_sentencepiece(docs, rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def brute(x):
        ids = sp.encode(x or "")
        return len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))

    assert bag(sp_codec.encode_digests(docs, PIECES).collect()) == bag((i, *brute(x)) for i, x in rows)
    assert sp_codec.encode_digests(empty, PIECES).count() == 0
    both = sp_codec.decode_ids(sp_codec.encode_ids(docs, PIECES), PIECES)
    assert both.where("coalesce(text, '') <> decoded").count() == 0 and both.columns[:3] == ["doc_id", "text", "lang"]


def test_sentencepiece_on_random_text():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp_codec.PieceModel.get(PIECES)
    rnd = random.Random(1)
    al = ["a", "b", "e", "t", "h", " ", "  ", "\n", "the", "in", "▁", "é", "😀", "0", "-", "ing", "\t", "中", "aa", "s", "<0x0A>", "\x00"]
    texts = ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [" " * n + "the" for n in range(40)] + ["a" * 999, "ab" * 500]
    assert [[i for w in g for i in w[3]] for g in own.encode_words(texts)] == sp.encode(texts)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randint(35, 130), rnd.randint(259, 31999)]) for _ in range(rnd.randint(1, 9))]
        assert own.decode(ids) == sp.decode(ids)


# --- op4, op7


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    near = x[0] + 0.02 * rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), 1) for i, v in enumerate(near)]
    rows += [(2000, x[5].tolist(), 2), (2001, x[5].tolist(), 2), (2002, (3 * x[5]).tolist(), 2), (2003, x[5].tolist(), None), (2004, x[5].tolist(), 0)]
    rows += [(2100, None, 1), (2101, [0.0] * 16, 1), (2102, [None] + [1.0] * 15, 1), (2103, [float("nan")] + [1.0] * 15, 1), (2104, [float("inf")] + [1.0] * 15, 1)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, vec int").repartition(3)


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_embedding_links(vectors):
    rows, df = vectors
    good = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if usable(v) and k is not None]
    links = {i: {j for j, w, m in good if j != i and m == k and v @ w >= 0.98} for i, v, k in good}

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    want = [(i, len(links.get(i, ())), component(i) if i in links else i) for i, _, _ in rows]
    assert bag(embed_dedup.near_duplicates(df).collect()) == bag(want)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_lose_no_link(vectors, monkeypatch):
    rows, df = vectors
    before = bag(embed_dedup.near_duplicates(df).collect())
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    assert bag(embed_dedup.near_duplicates(df).collect()) == before


def test_nearest_neighbours(vectors):
    rows, df = vectors
    good = {i: np.array(v) for i, v, _ in rows if usable(v)}
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.distance))
    assert set(got) == {i for i in good if i % 100 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [i for i, _ in found] == [i for _, i in want]  # fewer rows than are reranked: exact
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 32))
    found = ann.search_block(x, np.arange(6000), x[:60], x[100:356], 11, ann.PLACES, ann.RERANKED, ann.LEAST)
    hits = 0
    for q in range(60):
        want = set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:11])
        hits += len(want & set(found[1][found[0] == q]))
    assert hits / 660 >= 0.9


# --- op5


def brute_fingerprint(x):
    w = (x or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(x) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]
    got = simhash.near_duplicates(docs).select("id", simhash.hex_of(F.col("fp")), "component_id").collect()
    assert bag(got) == bag(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    groups = collections.defaultdict(set)
    for k, (i, x) in enumerate(rows):
        groups[find(k)].add((i, x))
    assert len(kept) == len(groups)
    for i, x in kept:
        group = next(g for g in groups.values() if (i, x) in g)
        assert i == min((j for j, _ in group if j is not None), default=None)


def test_links_find_every_near_pair(spark, monkeypatch):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:20]:
        for _ in range(60):
            x = b
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    points = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    edges = simhash.links(points, 1 << 20, simhash.Stages(spark, "test")).distinct().collect()
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        parent[find(e.u)] = find(e.v)
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                assert find(i) == find(j)


# --- op6


def check_packing(got, rows):
    tok = Tokenizer.from_file(WORDS)
    want = collections.Counter(tuple([*tok.encode(x or "", add_special_tokens=False).ids, 1]) for _, x in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        n = 0
        for r in pieces:
            assert r.offset == n and r.length > 0
            n += r.length
        assert n <= 2048 and (n == 2048 or n & (n - 1) == 0)
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    ids = {}
    for i, x in rows:
        ids.setdefault(i, []).append([*tok.encode(x or "", add_special_tokens=False).ids, 1])
    for r in got:
        assert any(len(d) == r.doc_tokens and zlib.crc32(np.array(d[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for d in ids[r.doc_id])


def test_packing(docs, rows, empty):
    check_packing(packing.pack(docs, WORDS).collect(), rows)
    check_packing(packing.pack(docs, WORDS, windows=1).collect(), rows)
    assert packing.pack(empty, WORDS).count() == 0


CONTEXTS = ("{}.", ".{}a", "a{}1", "'s{},", "a {}'t")


def check_units(texts):
    tok, own = Tokenizer.from_file(WORDS), packing.UnitEncoder.get(WORDS)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, w, g in zip(texts, want, own.encode(texts), strict=True) if w != g] == []


def test_characters_of_other_normal_forms_encode_as_whole_texts():
    chars = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    other = [c for c in chars if not 0xAC00 <= ord(c) < 0xD7A4 and any(unicodedata.normalize(f, c) != c for f in ("NFC", "NFD"))]
    assert len(other) > 2000
    check_units([x.format(c) for c in other + chars[:0x600] for x in CONTEXTS])


def test_units_encode_as_whole_texts(monkeypatch):
    rnd = random.Random(9)
    al = ["a", "B", "É", "é", "e\u0301", "\u0301", "=\u0338", "'", "'s", "'S", "don't", ".", ",", "###", "-", "_", "1", "23", "²", "Ⅷ", "漢", "각", "ᄀ", "ᅡ", "😀", " ", "\n", "\u00a0", "\u2003", "<|", "|>", "<|endoftext|>", "İ", "Σ", "ΑΣ", "K", "ß", "€", "\u200b", "!", "(", ")", "a.b"]
    texts = ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 12))) for _ in range(20000)]
    check_units(texts)
    monkeypatch.setattr(packing.UnitEncoder, "SLICE", 20)
    check_units([" ".join(texts[i : i + 9]) for i in range(0, 2000, 9)])


# --- op8


def test_composed_table_is_total():
    table, start = toxicity.compose()
    assert start in {s for s, _ in table} and all((t, 0) in table for t, _ in table.values())


def test_grammar_scores_clauses():
    g = toxicity.Grammar(toxicity.Lexicon({}))
    plain, aimed, denied, told = (g.features(t) for t in ("what an idiot.", "you idiot.", "he is not an idiot.", "they wrote idiot."))
    assert plain[0] > 0 and aimed[3] > 0 and denied[4] > 0 and denied[0] == 0 and told[5] > 0
    model = toxicity.Model({}, toxicity.PRIOR)
    s = model.scores(np.array([g.features("a fine day."), plain, aimed, told]))
    assert s[0] < 0.5 and s[0] < s[3] < s[1] < s[2]


def test_toxicity_held_out(spark, empty):
    d = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 3000"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs, model).join(labels, "doc_id").where((toxicity.fold(F.col("doc_id")) == 0) & (F.col("lang") == "en"))
    r = held.agg(F.avg((F.col("toxicity") >= 0.5).cast("int").eqNullSafe(F.col("toxic")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.95
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "toxicity"] and got.where("toxicity < 0 or toxicity > 1 or toxicity is null").count() == 0


def test_tasks_free_what_earlier_ones_kept(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    rows = pa.RecordBatch.from_pydict({"t": ["one two", None], "toxic": [1, 0], "half": [0, 1], "id": [1, 2], "rid": [3, 4]})
    for task in (
        lambda: toxicity._count_terms(iter([rows])),
        lambda: toxicity._features({}, ["id"])(iter([rows])),
        lambda: simhash._fingerprints(iter([rows])),
        lambda: simhash._compare(iter([]), 3),
    ):
        kept = common.worker_held(("cache of another operator",), dict)
        assert common.worker_held(("cache of another operator",), dict) is kept
        list(task())
        assert not common._held


def test_terms_are_handed_on_in_parts(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(3, 9) for _ in range(30)) for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"t": [t], "toxic": [i % 3 == 0], "half": [i % 2]}) for i, t in enumerate(texts)]

    def counted():
        total = collections.defaultdict(lambda: np.zeros(4, int))
        sizes = []
        for b in toxicity._count_terms(iter(batches)):
            sizes.append(b.num_rows)
            for r in b.to_pylist():
                total[r["term"]] += [r[c] for c in ("tox_a", "clean_a", "tox", "clean")]
        return {k: tuple(v) for k, v in total.items()}, sizes

    assert toxicity.HELD_TERMS <= 100_000
    whole, one = counted()
    monkeypatch.setattr(toxicity, "HELD_TERMS", 50)
    parts, several = counted()
    assert parts == whole and len(one) == 1 and len(several) > 5 and whole[""] == (7, 13, 14, 26)


# --- op9


def brute_repeats(rows, window=50):
    first = {}
    for i, x in rows:
        w = (x or "").encode().split()
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, x in rows:
        w = (x or "").encode().split()
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), [v for k, v in enumerate(w) if k not in gone]))
    return out


def test_substring(docs, rows, empty):
    want = brute_repeats(rows)
    assert bag(substring.digest_without_repeats(docs).collect()) == bag((i, n, r, digest(b" ".join(k))) for i, n, r, k in want)
    assert substring.digest_without_repeats(empty).count() == 0


def test_substring_texts(docs, rows):
    got = substring.remove_repeats(docs)
    want = [(i, x if not r else b" ".join(k).decode()) for (i, x), (_, _, r, k) in zip(rows, brute_repeats(rows), strict=True)]
    assert got.columns == docs.columns and bag((r.doc_id, r.text) for r in got.collect()) == bag(want)


def test_substring_by_shuffle(docs, rows, monkeypatch):
    monkeypatch.setattr("webtel.llm.common.BROADCAST_BYTES", -1)
    got = substring.digest_without_repeats(docs)
    assert bag(got.collect()) == bag((i, n, r, digest(b" ".join(k))) for i, n, r, k in brute_repeats(rows))


# --- queries and pipeline


def test_names():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_pipeline(spark):
    """Each stage against a brute-force version of what it keeps."""
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        steps.append(f(spark, steps[-1], d).cache())
    texts = [[(r.doc_id, r.text) for r in s.orderBy("doc_id").collect()] for s in steps[:-1]]
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert set(texts[1]) < set(texts[0])
    fps = [(i, brute_fingerprint(x)) for i, x in texts[1]]
    comp = {i: i for i, _ in fps}
    for _ in fps:
        new = {i: min(comp[j] for j, g in fps if (f ^ g).bit_count() <= 3) for i, f in fps}
        if new == comp:
            break
        comp = new
    assert texts[2] == [(i, x) for i, x in texts[1] if comp[i] == i]
    assert texts[3] == [(i, x if not r else b" ".join(k).decode()) for (i, x), (_, _, r, k) in zip(texts[2], brute_repeats(texts[2]), strict=True)]
    assert [i for i, _ in texts[4]] == [i for i, _ in texts[3]]
    for (_, old), (_, new) in zip(texts[3], texts[4], strict=True):
        assert not brute_secrets(old) or "[SECRET]" in new
        assert old == new or "[SECRET]" in new
    check_packing(steps[-1].collect(), texts[4])
