"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A normalised text is cut into words that no piece crosses. The words that
are new to a batch are laid out as one flat symbol array. Each round looks
up the rank of every neighbouring pair, takes the smallest rank of each
word, merges all its non-overlapping occurrences from the left, compacts the
array and goes on until no pair can be merged. Merging occurrences together
equals merging them one by one only if no pair that arises ranks as well as
the one just merged; words where one does are merged one by one instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import small_batches, without, worker_held

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.bytes_of = {}
        self.ids = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.bytes_of[i] = int(p[1:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.names, self.texts = list(map(str, range(n))), [self.text_of.get(i, "") for i in range(n)]
        # Rank: by falling score; pieces of equal score share a rank and the leftmost pair wins.
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.n, self.pairs = n, pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        # Words are cut before a run of spaces, and around every line end (which no longer piece holds).
        if any(SPACE in p.lstrip(SPACE) or len(p) > 1 and "\n" in p for p in self.ids):
            raise ValueError("a piece of this model crosses words")
        run = max(len(p) for p in self.ids if not p.strip(SPACE))
        self.word = re.compile(f"{SPACE}{{{run}}}(?={SPACE})|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.most, self.known = most, {}

    @classmethod
    def get(cls, path: str) -> PieceModel:
        return worker_held((cls, path), lambda: cls(path))

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1. Symbols without a piece are negative."""
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """The best pair first, the leftmost of equal ones; O(n log n) for one word."""
        n = len(sym)
        sym, after, before = list(sym), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and sym[a] >= 0 and sym[b] >= 0:
                m = self.pairs.get(sym[a] * self.n + sym[b])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), a, sym[a], sym[b], m))

        dead = [False] * n
        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, x, y, m = heapq.heappop(heap)
            if dead[a] or sym[a] != x:
                continue
            b = after[a]
            if b >= n or sym[b] != y:
                continue
            sym[a], dead[b], after[a] = m, True, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [s for s, d in zip(sym, dead, strict=True) if not d]

    def merge_rounds(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word after all merges; a character without a piece is -1 - code point."""
        chars = "".join(words)
        ids = self.ids
        one = {c: ids.get(c, -1 - ord(c)) for c in set(chars)}
        sym = np.fromiter(map(one.__getitem__, chars), dtype=np.int64, count=len(chars))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        seg = np.repeat(np.arange(len(words)), lengths)
        out: list[list[int]] = [[]] * len(words)

        def settle(sym: np.ndarray, seg: np.ndarray) -> None:
            if len(seg):
                cut = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                flat = sym.tolist()
                for w, s, e in zip(seg[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(flat)], strict=True):
                    out[w] = flat[s:e]

        to = np.full(len(sym), -1, dtype=np.int64)
        same = np.flatnonzero(seg[:-1] == seg[1:])
        to[same] = self.merged(sym[same], sym[same + 1])
        while len(sym):
            rank = np.where(to >= 0, self.rank[to], NONE)
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            alive = np.repeat(best != NONE, sizes)
            settle(sym[~alive], seg[~alive])
            pick = (rank == np.repeat(best, sizes)) & alive
            # Of picks that follow each other directly, every second one from the left is taken.
            at = np.flatnonzero(pick)
            if len(at):
                run = np.append(True, (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]]))
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            new, keep = sym.copy(), alive.copy()
            new[at] = to[at]
            keep[at + 1] = False
            fresh = np.zeros(len(sym), dtype=bool)
            fresh[at] = True
            new, fresh, new_seg, new_to = new[keep], fresh[keep], seg[keep], to[keep]
            # Only pairs with a merged symbol have changed.
            new_to[fresh] = -1
            beside = np.flatnonzero((fresh[:-1] | fresh[1:]) & (new_seg[:-1] == new_seg[1:]))
            made = self.merged(new[beside], new[beside + 1])
            new_to[beside] = made
            low = np.repeat(best, sizes)[keep][beside]
            unsafe = np.unique(new_seg[beside][(made >= 0) & (self.rank[made] <= low)])
            if len(unsafe):
                old = np.isin(seg, unsafe)
                cut = np.flatnonzero(np.append(True, seg[old][1:] != seg[old][:-1]))
                for w, part in zip(seg[old][cut].tolist(), np.split(sym[old], cut[1:]), strict=True):
                    out[w] = self._one_by_one(part.tolist())
                rest = ~np.isin(new_seg, unsafe)
                new, new_seg, new_to = new[rest], new_seg[rest], new_to[rest]
            sym, seg, to = new, new_seg, new_to
        return out

    def _finish(self, symbols: list[int]) -> tuple[int, str, str, list[int]]:
        """Count, ids and text of a word; characters without a piece become bytes."""
        if min(symbols) >= 0:
            return len(symbols), ",".join([self.names[i] for i in symbols]), "".join([self.texts[i] for i in symbols]), symbols
        ids: list[int] = []
        for s in symbols:
            ids += [s] if s >= 0 else self.byte_id[list(chr(-1 - s).encode())].tolist()
        return len(ids), ",".join(map(str, ids)), self.decode_run(ids), ids

    def decode_run(self, ids: list[int]) -> str:
        """Text of ids: pieces with spaces restored, runs of byte pieces as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            out.append(self.text_of.get(i, ""))
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a whole sequence: the space that encoding puts in front goes."""
        text = self.decode_run(ids)
        return text[1:] if text.startswith(" ") and ids[0] not in self.bytes_of else text

    def words(self, text: str) -> list[str]:
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_words(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its words' (count, ids, text, id list)."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, map(self._finish, self.merge_rounds(part)), strict=True))
        return [list(map(self.known.__getitem__, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.encode_words([text])[0] for i in w[3]]


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that is not part of a valid character gives U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_tokens, ids_sha256, decoded_sha256).

    A null or empty text has no ids and decodes to the empty text. Texts may
    be of any length: their words are encoded in slices. Ids may be null or
    repeat; repeated rows give repeated rows; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        model = PieceModel.get(model_path)
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            counts, ids, back = [], [], []
            for words in model.encode_words(texts):
                counts.append(sum(w[0] for w in words))
                ids.append(hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest())
                text = "".join([w[2] for w in words])
                back.append(hashlib.sha256((text[1:] if text.startswith(" ") else text).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return base.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """`docs` with a column `ids`, the token ids of each text (empty for null and empty texts).

    Texts may be of any length and rows may repeat; an empty table gives an
    empty result; a column `ids` that `docs` has is replaced.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, "ids")
    schema = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", ids array<int>"

    def run(batches):
        model = PieceModel.get(model_path)
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            ids = [[i for w in words for i in w[3]] for words in model.encode_words(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-1], "ids"])

    cols = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    out = docs.select(*cols, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], "ids")


def decode_ids(frame: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """`frame` with a column `decoded`, the text of each row's ids (null ids: null, no ids: empty).

    Rows may repeat; an empty table gives an empty result; a column `decoded`
    that `frame` has is replaced.
    """
    small_batches(frame.sparkSession)
    frame = without(frame, "decoded")
    schema = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(frame.dtypes)) + ", decoded string"

    def run(batches):
        model = PieceModel.get(model_path)
        for b in batches:
            ids = b.column(b.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if x is None else model.decode(x) for x in ids], pa.string())], [*b.schema.names[:-1], "decoded"])

    cols = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(frame.columns)]
    out = frame.select(*cols, F.col(ids_col).alias("_t")).mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(frame.columns)], "decoded")
