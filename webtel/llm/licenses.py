"""License scans by a positional index of rare words.

Each template (a phrase with a label) posts its words of highest inverse
document frequency, with their positions. A file's words that have postings
give alignments (template, start in the file); postings of one template that
agree on the start intersect there. An alignment to which all posted words
of its template agree is verified: the template's mandatory phrase must stand
there word for word. Document frequencies are counted over all documents.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import small_batches, texts_of

#: Base phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further templates: (label, template, mandatory phrase inside it).
FURTHER = [
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc-by", "creative commons attribution license", "creative commons attribution"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms with or without modification"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl", "eclipse public license", "eclipse public license"),
]

_WORD = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Upper-case letters to lower case, all other ASCII but letters and digits to a space; bytes of other characters stay.
_TABLE = bytes(c if c >= 128 or c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Template:
    def __init__(self, label: str, text: str, key: str, base: bool):
        self.label, self.base = label, base
        self.words = [w.encode() for w in text.split()]
        self.key = [w.encode() for w in key.split()]
        self.key_at = next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)


def templates() -> list[Template]:
    return [Template(label, phrase, phrase, True) for phrase, label in BASE.items()] + [Template(*t, False) for t in FURTHER]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and documents that hold each word of a fixed vocabulary; over all rows."""

    def run(batches):
        n, df = 0, Counter()
        for b in batches:
            for t in texts_of(b, "t"):
                n += 1
                df.update(vocabulary.intersection(words_of(t)))
        df[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in df]), pa.array(list(df.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word.encode(): r.n for r in counts.collect()}  # one row for each word of the fixed vocabulary
    return found.pop(b"", 0), found


class RareWordIndex:
    """Postings of the `rare` highest-IDF words of each template."""

    def __init__(self, all_templates: list[Template], n_docs: int, df: dict[bytes, int], rare: int = 2):
        self.templates = all_templates
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for t in all_templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.posted = []
        for k, t in enumerate(all_templates):
            best = sorted(range(len(t.words)), key=lambda i: (-self.idf[t.words[i]], i))[:rare]
            self.posted.append(len(best))
            for i in best:
                self.postings.setdefault(t.words[i], []).append((k, i))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[str], float]:
        """Base places (start, label), labels of further templates, and a score.

        The score is the IDF-weighted share of a template's words that stand
        at an alignment: from 0.5 for a verified one, to 0.5 for another.
        """
        starts: Counter = Counter()
        for i, w in enumerate(words):
            if w in self.postings:
                for k, at in self.postings[w]:
                    starts[k, i - at] += 1
        base, labels, score = [], [], 0.0
        for (k, s), agree in starts.items():
            t = self.templates[k]
            if agree < self.posted[k] or s + t.key_at < 0:
                continue
            here = [0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(t.words)]
            share = sum(self.idf[w] for w, h in zip(t.words, here, strict=True) if h) / sum(map(self.idf.get, t.words))
            verified = words[s + t.key_at : s + t.key_at + len(t.key)] == t.key
            if verified and t.base:
                base.append((s, t.label))
            elif verified:
                labels.append(t.label)
            score = max(score, 0.5 * verified + 0.5 * share)
        return sorted(base), labels, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    A null or empty text has no words, no labels (empty strings) and score 0.
    Texts of any length are read as a whole, one at a time. Ids may be null
    or repeat; equal rows get equal results; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    known = templates()
    index = RareWordIndex(known, *document_frequencies(docs, {w for t in known for w in t.words}, text_col))

    def run(batches):
        for b in batches:
            out = []
            for t in texts_of(b, "t"):
                words = words_of(t)
                base, labels, score = index.scan(words)
                own = {label for _, label in base}
                out.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own.union(labels))), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return base.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
