"""Features, fit and masks of identifiers against versions that work on strings, letter by letter."""

import math
import random
import re
from urllib.parse import quote, unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtel.functions import classify, masking

WORDS = "the quick brown fox jumps over lazy dogs while every other animal watches and nothing else happens around here today"
MARK = "#??#"


@pytest.fixture(scope="module")
def model(spark):
    pairs = classify.bigram_model(spark.createDataFrame([(WORDS,)] * 3, "t string"), "t", 0.2, classify.KNOWN)
    return classify.IdentifierModel(pairs, 3.0, (-60.0, -0.4, 2.0, -1.0, 4.0))


def features(x, pairs):
    x = x.lower()
    known = [classify.KNOWN.index(c) for c in x if c in classify.KNOWN]
    logs = [pairs[a, b] for a, b in zip(known, known[1:], strict=False)]
    letters = [c for c in x if "a" <= c <= "z"]
    plain = [c for c in x if "a" <= c <= "z" or "0" <= c <= "9"]
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(plain, plain[1:], strict=False))
    return (
        math.exp(sum(logs) / len(logs)) if logs else 1.0,
        -sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x)),
        sum(c in "0123456789abcdef" for c in x) / len(x) if x else 0.0,
        sum(c in "aeiou" for c in letters) / len(letters) if letters else 0.0,
        changes / (len(x) - 1) if len(x) > 1 else 0.0,
    )


def goes(x, m):
    if len(x) < 8:
        return False
    if re.fullmatch(r"@?[0-9,.]+z?", x):
        return True
    for a, b, least in masking.SCRIPTS:
        run = 0
        for c in x:
            run = run + 1 if a <= c <= b else 0
            if run >= least:
                return False
    if re.fullmatch("[0-9]+x[0-9]+", x):
        return False
    if re.fullmatch("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", x):
        return True
    z = m.bias + sum(w * f for w, f in zip(m.weights, features(x, m.pairs), strict=True))
    return 1 / (1 + math.exp(-z)) > m.cut


def brute_spans(x, lo, hi, m):
    for n in range(hi - lo, 7, -1):
        for s in range(hi - n, lo - 1, -1):
            if goes(x[s : s + n], m):
                return [*brute_spans(x, lo, s, m), (s, s + n), *brute_spans(x, s + n, hi, m)]
    return []


def brute_prefix(x, m, words=10):
    hit = re.match("[a-zα-ω؀-ۿა-ჿа-џա-և]+-", x)
    if not words or not hit:
        return [], x
    behind, rest = brute_prefix(x[hit.end() :], m, words - 1)
    joined = "".join(behind)
    if goes(joined, m):
        behind = [MARK]
    word = hit[0][:-1]
    return [MARK if goes(word, m) else word, "-", *behind], rest


def brute_body(x, m):
    """The masked text; None stands for a mark, so that marks and text can't be confused."""
    if goes(x, m) or (len(x) >= 12 and "+" in x.strip("+")):
        return MARK
    prefix, rest = brute_prefix(x, m)
    spans, at, parts = brute_spans(rest, 0, len(rest), m), 0, list(prefix)
    for s, e in spans:
        parts += [rest[at:s], MARK]
        at = e
    text = re.sub(r"(?:#\?\?#)+", MARK, "".join([*parts, rest[at:]]))
    while MARK in text and text != MARK:
        last = text.rindex(MARK)
        after = len(text) - last - 4
        if 0 < after <= 8:
            text = text[: last + 4]
            continue
        before = text.rfind(MARK, 0, last)
        if before < 0 or last - before - 4 > 6:
            break
        text = text[: before + 4]
    return text


def brute_text(x, m):
    if len(x) >= 128:
        out = brute_body(x[:124], m)
        return out if out.endswith(MARK) else out + MARK
    return brute_body(x, m)


def texts():
    rnd = random.Random(4)
    known = ["", "a", "index.html", "12345678", "1234567", "@45.5335096,9.5914633,6z", "48.15,11.63", "LONDON+CITY+AIRPORT", "a+b", "+++++++++++++", "1920x10800", "de305d54-75b4-431b-adb2-eb6b9e546014"]
    known += ["news-of-today-a-de305d54-75b4-431b-adb2-eb6b9e546014", "ab-cd-ef-gh-ij-kl-mn-op-qr-st-uv-wx", "x7qz9k2vw4" * 13, "quick-brown-fox-" * 10, "мой-сайт-x7qz9k2vw4", "αβγ-x7-q9", "😀x7qz9k2vw4😀", "a#??#b", "x" * 128, "y" * 127]
    bits = ["the", "-", "quick", "x7qz9k2vw4", "Qz", "8f", "_", ".", "é", "漢", "+", "0x1f", "12", "fox", "IKbW", "aé-"]
    known += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    known += ["".join(rnd.choice("abcxyzQZ0189-_.+@%") for _ in range(rnd.randint(6, 24))) for _ in range(100)]
    return list(dict.fromkeys(known))


def test_features_and_score(spark, model):
    some = [x for x in texts() if x and "%" not in x] + ["%D0%BC%D0%BE%D0%B9", "100%", "SW1A1AA", "abc"]
    df = spark.createDataFrame([(x,) for x in [*some, None, ""]], "x string")
    got = df.select("x", classify.identifier_features(F.col("x"), model.pairs).alias("f"), classify.identifier_score(F.col("x"), model).alias("s")).collect()
    assert len(got) == len(some) + 2
    for r in got:
        if r.x is None:
            assert r.s is None
        elif r.x:
            want = features(unquote(r.x), model.pairs)
            assert np.allclose(want, tuple(r.f), rtol=1e-12, atol=1e-12), r.x
    by = {r.x: r.s for r in got}
    assert by["SW1A1AA"] == 0 and by["12345678"] == 0 and by["abc"] == 0 and by["de305d54-75b4-431b-adb2-eb6b9e546014"] == 1
    assert by["x7qz9k2vw4"] > 0.8 if "x7qz9k2vw4" in by else True


def test_masks(spark, model):
    some = texts()
    got = {r.x: r.masked for r in masking.mask_column(spark.createDataFrame([(x,) for x in [*some, None, some[0], some[5]]], "x string"), "x", model).collect()}
    for x in some:
        if "%" in x:
            continue
        want = MARK if MARK in x else brute_text(x, model)
        assert got[x] == want, x
        assert len(want) <= max(len(x), 4)
    assert got[None] is None and got[""] == "" and got["@45.5335096,9.5914633,6z"] == MARK and got["LONDON+CITY+AIRPORT"] == MARK
    assert sum(v != x for x, v in got.items()) > 60


def test_masks_are_carried_back_to_encoded_text(spark, model):
    rnd = random.Random(9)
    plain = [x for x in texts() if MARK not in x and "%" not in x]
    encoded = {}
    for x in plain:
        units = [quote(c, safe="") if rnd.random() < 0.4 or ord(c) > 127 and rnd.random() < 0.8 else c for c in x]
        encoded["".join(units)] = (x, units)
    got = {r.x: r.masked for r in masking.mask_column(spark.createDataFrame([(x,) for x in encoded], "x string"), "x", model).collect()}
    for e, (x, units) in encoded.items():
        want, at, out = brute_text(x, model), 0, []
        for k, piece in enumerate(want.split(MARK)):
            # text in front of the first mark begins at 0, that behind the last ends at the end; between, the position is found from behind
            start = 0 if k == 0 else len(x) - len(piece) if k == want.count(MARK) else x.index(piece, at)
            out.append("".join(units[start : start + len(piece)]))
            at = start + len(piece)
        if want.count(MARK) <= 1:
            assert got[e] == MARK.join(out), (e, x)
        assert unquote(got[e].replace(MARK, "\0")).replace("\0", MARK) == want, e


def test_broken_encodings_are_judged_as_they_are(spark, model):
    broken = ["%FFx7qz9k2vw4", "%C3", "100%-quick", "%ED%A0%80abcdefg", "%C0%80", "%23%3F%3F%23", "%4048.15,11.63"]
    got = {r.x: r.masked for r in masking.mask_column(spark.createDataFrame([(x,) for x in broken], "x string"), "x", model).collect()}
    for x in broken[:-1]:
        assert got[x] == brute_text(x, model), x
    assert got["%4048.15,11.63"] == MARK


def test_hosts(spark, model):
    hosts = ["example.com", "x7qz9k2vw4qz.example.com", "x7qz9k2vw4qz.com", "www.example.co.uk", None, "de305d54-75b4-431b-adb2-eb6b9e546014.a.example.com"]
    got = {r.h: r.masked for r in masking.mask_hosts(spark.createDataFrame([(h, 1) for h in [*hosts, hosts[1]]], "h string, _at int"), "h", model).collect()}
    assert got == {**{h: h for h in hosts}, hosts[1]: "#??#.example.com", hosts[5]: "#??#.a.example.com"}


def test_fit(spark, model):
    rnd = random.Random(2)
    rows = [("-".join(rnd.sample(WORDS.split(), 2)), 0) for _ in range(80)] + [("".join(rnd.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(8, 20))), 1) for _ in range(80)]
    rows += [("x7qz9k2vw4", 0), ("lazy-dogs-here", 1)]
    df = spark.createDataFrame([*rows, (None, 1), ("unlabelled", None)], "x string, y int").repartition(3)
    got = classify.fit_identifiers(df, "x", "y", model.pairs)
    x = np.array([(1.0, *features(t, model.pairs)) for t, _ in rows])
    y = np.array([label for _, label in rows], dtype=float)
    w = np.zeros(6)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-3 * np.eye(6), x.T @ (p - y) / len(y) + 1e-3 * w)
    assert np.allclose(w, [got.bias, *got.weights], rtol=1e-6, atol=1e-6)
    right = df.where("y is not null and x is not null").select(((classify.identifier_score(F.col("x"), got) > 0.5) == (F.col("y") == 1)).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.95
    assert classify.fit_identifiers(df.limit(0), "x", "y", model.pairs).weights == (0.0,) * 5
    part = classify.fit_identifiers(df, "x", "y", model.pairs, most=60)
    assert part.weights != got.weights and right.count() > 160
