"""Packing tokenised documents into sequences with bounded-space online best fit.

Each partition keeps a fixed number of open windows. Whole windows' worth of
a long document become sequences of their own; the rest goes to the open
window that it fills best. When none has room, the fullest is topped up with
the front of the piece, emitted full, and the remainder is placed again. At
the end a partition cuts its open windows, joined, into full sequences and
hands on a tail of less than one window. Tails of many partitions are merged
in two further rounds; the last tail is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import small_batches, worker_held
from webtel.session import Stages

ID_BYTES = 4
#: Tails that one task of the first merging round takes.
TAILS = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tail binary"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tail", pa.binary())])


#: Letters that a normal form leaves alone and that have one lower case; sigma's depends on its place.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower() < "\u0530" and c != "Σ")
_SPACE, _MARKS = r"\x20\t-\r", r"!-/:-@\[-`{-~"


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class UnitEncoder:
    """Ids of texts by a `tokenizers` file that applies NFC, lower-cases, drops white space and parts letters, digits and the rest.

    A text is cut into units where the pre-tokeniser cuts it too: short forms
    behind an apostrophe, runs of letters, digits, runs of punctuation. That
    is done only between known characters, which are ASCII and letters that
    no normal form changes or joins. A unit before any other character, such
    as a combining mark, takes all up to the next white space with it in its
    original case. A text that holds an added token's string is encoded
    whole. Units are remembered, so that each is encoded once; of two
    generations of units the older goes when the newer is full.
    """

    SHORT = "'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])"
    KNOWN = re.compile(f"{SHORT}|[{_LETTERS}]++|[0-9]|[{_MARKS}]++")
    OTHER = re.compile(f"[^{_SPACE}{_MARKS}0-9{_LETTERS}]")
    CAREFUL = re.compile(f"(?!{SHORT}{OTHER.pattern})(?:{KNOWN.pattern})(?!{OTHER.pattern})|[^{_SPACE}]++")
    #: Characters that are cut into units at once.
    SLICE = 1 << 20

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task on each core already
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.units, self.older = Tokenizer.from_file(path), most, {}, {}
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The model reads bytes as characters; the pre-tokeniser has the table.
        pre = self.tokenizer.pre_tokenizer
        self.bytes = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in _LETTERS if not c.isascii()}

    @classmethod
    def get(cls, path: str) -> UnitEncoder:
        return worker_held((cls, path), lambda: cls(path))

    def cut(self, text: str) -> list[str]:
        if any(a in text for a in self.added):
            return [text]
        if not self.OTHER.search(text):
            return self.KNOWN.findall(text.lower())
        return self.CAREFUL.findall(text)

    def slices(self, text: str):
        """Parts of a text of about SLICE characters that end before white space."""
        at = 0
        while len(text) - at > self.SLICE and not any(a in text for a in self.added):
            m = re.compile(f"[{_SPACE}]").search(text, at + self.SLICE)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def learn(self, units: list[str], size: int = 10_000) -> None:
        """Ids of new units. One that is a known run is one word of the pre-tokeniser, so that the model alone is asked."""
        others = []
        for u in units:
            if self.KNOWN.fullmatch(u):
                low = u.lower()
                got = self.model.tokenize(low if low.isascii() else low.translate(self.bytes))
                self.units[u] = pack_ids([t.id for t in got])
            else:
                others.append(u)
        for i in range(0, len(others), size):
            got = self.tokenizer.encode_batch_fast(others[i : i + size], add_special_tokens=False)
            self.units.update(zip(others[i : i + size], (pack_ids(e.ids) for e in got), strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.units)
        again = new.intersection(self.older)
        self.units.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self.learn(list(new.difference(again)))
        of = self.units.__getitem__
        out = [b"".join(map(of, c)) for c in cut]
        if len(self.units) > self.most:
            self.units, self.older = {}, self.units
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; about SLICE characters are worked on at once."""
        out, parts, held, n = [[] for _ in texts], [], [], 0
        for k, t in enumerate(texts):
            for part in self.slices(t):
                parts.append(part)
                held.append(k)
                n += len(part)
                if n >= self.SLICE:
                    for j, ids in zip(held, self._encode(parts), strict=True):
                        out[j].append(ids)
                    parts, held, n = [], [], 0
        for j, ids in zip(held, self._encode(parts), strict=True):
            out[j].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


class Packer:
    """The online packer of one partition; emitted rows gather in `rows`."""

    def __init__(self, size: int, windows: int, first_sequence: int):
        self.size, self.windows, self.next = size, windows, first_sequence
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // ID_BYTES
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, None))
            at += n
        self.next += 1

    def document(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // ID_BYTES
        whole = total - total % self.size
        for s in range(0, whole, self.size):
            self.emit([(doc, s, ids[s * ID_BYTES : (s + self.size) * ID_BYTES], total)])
        if whole < total:
            self.place((doc, whole, ids[whole * ID_BYTES :], total))

    def place(self, piece: tuple) -> None:
        n = len(piece[2]) // ID_BYTES
        best = max((w for w in self.open if w[0] + n <= self.size), key=lambda w: w[0], default=None)
        if best is None and len(self.open) >= self.windows:
            best = max(self.open, key=lambda w: w[0])
            doc, start, ids, total = piece
            room = self.size - best[0]
            best[1].append((doc, start, ids[: room * ID_BYTES], total))
            self.open.remove(best)
            self.emit(best[1])
            self.place((doc, start + room, ids[room * ID_BYTES :], total))
            return
        if best is None:
            best = [0, []]
            self.open.append(best)
        best[0] += n
        best[1].append(piece)
        if best[0] == self.size:
            self.open.remove(best)
            self.emit(best[1])

    def cut(self, pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
        """The first n ids of a run of pieces, and the rest."""
        head = []
        for k, (doc, start, ids, total) in enumerate(pieces):
            have = len(ids) // ID_BYTES
            if have > n:
                if n:
                    head.append((doc, start, ids[: n * ID_BYTES], total))
                return head, [(doc, start + n, ids[n * ID_BYTES :], total), *pieces[k + 1 :]]
            head.append((doc, start, ids, total))
            n -= have
            if not n:
                return head, pieces[k + 1 :]
        return head, []

    def finish(self, last: bool) -> None:
        """Merge the open windows; the tail is handed on, or cut into powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(w[0] for w in self.open)
        self.open = []
        while left >= self.size or last and left:
            n = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            head, rest = self.cut(rest, n)
            self.emit(head)
            left -= n
        self.rows += [(doc, start, len(ids) // ID_BYTES, 0, total, -1, 0, ids) for doc, start, ids, total in rest]

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)] if rows else [pa.array([], f.type) for f in _FIELDS], schema=_FIELDS)


def _pack_partition(path: str, end_id: int, size: int, windows: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        packer = Packer(size, windows, TaskContext.get().partitionId() << 32)
        encoder = UnitEncoder.get(path)
        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode([t or "" for t in b.column("t").to_pylist()]), strict=True):
                packer.document(doc, ids + end)
            yield packer.batch()
        packer.finish(False)
        yield packer.batch()

    return run


def _merge(size: int, windows: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        packer = Packer(size, windows, (1 << (62 if last else 61)) + (group << 32))
        for r in table.select(["doc_id", "start", "tail", "doc_tokens"]).to_pylist():
            packer.place((r["doc_id"], r["start"], r["tail"], r["doc_tokens"]))
        packer.finish(last)
        return pa.Table.from_batches([packer.batch()])

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, windows: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. A text of any length is read
    in slices and cut over as many sequences as it needs. Each row of `docs`
    is a document of its own, also if ids repeat or are null. An empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stages = Stages(spark, "packing")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    packed = stages.write(base.mapInArrow(_pack_partition(tokenizer_path, end_id, size, windows), PIECES).withColumn("part", F.spark_partition_id()), "packed")
    tails = packed.where("tail is not null").withColumn("grp", F.expr(f"cast(part div {TAILS} as long)")).drop("part")
    merged = stages.write(tails.groupBy("grp").applyInArrow(_merge(size, windows, False), PIECES), "merged")
    final = merged.where("tail is not null").withColumn("grp", F.lit(0).cast("long")).groupBy("grp").applyInArrow(_merge(size, windows, True), PIECES)
    out = packed.drop("part").where("tail is null").unionByName(merged.where("tail is null")).unionByName(final)
    return out.drop("tail")
