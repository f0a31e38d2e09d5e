"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is
the vector of the segments' bit counts. One differing bit changes one count
by one, so the Manhattan distance of embeddings is a lower bound of the
Hamming distance of fingerprints. Counts are kept in unary (00, 01, 11), so
that the Manhattan distance of two embeddings is the bit count of their xor.

The range join puts every embedding into grid cells. With the segments dealt
into g blocks, two embeddings within Manhattan distance 3 agree in at least
g - 3 blocks, so each choice of g - 3 blocks is one grid and the counts in
the chosen blocks are the cell. g follows the number of fingerprints, so that
cells stay small; large cells are dealt out in pairs of blocks of rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.llm.common import block_pairs, forest, group_starts, log2_ceil, release_held, row_key, small_batches, small_side, texts_of, whole_groups
from webtel.llm.graph import connected_components
from webtel.session import Stages

SEGMENTS, SEGMENT_BITS = 32, 2
#: Bits of information in one segment's count: 00, 01/10, 11 with chances 1/4, 1/2, 1/4.
SEGMENT_ENTROPY = 1.5
_LOW = 0x5555555555555555
#: Rows of a cell that are compared at once.
BLOCK = 512


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word n-grams; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < n:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[i : i + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    release_held()
    for b in batches:
        fps = np.array([fingerprint(t) for t in texts_of(b, "t")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.array(fps.view(np.int64))], ["id", "rid", "fp"])


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, fp): one row per row of `docs`, its row_key and the fingerprint as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return base.select("id", row_key("id", "t").alias("rid"), "t").mapInArrow(_fingerprints, "id long, rid long, fp long")


def embedding(fp: Column) -> Column:
    """Segment bit counts in unary: the low bit of a segment says one or more, the high bit two."""
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW)
    some = fp.bitwiseOR(high).bitwiseAND(low)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def grids(n: int, radius: int = 3) -> list[int]:
    """Masks, as signed longs, of the segments that must agree, one for each grid.

    The number of blocks is the least for which a cell's counts carry
    log2(n) bits, so that chance cells hold about one row.
    """
    need = min(log2_ceil(n), 34)
    for g in range(radius + 1, 13):
        edges = [round(i * SEGMENTS / g) for i in range(g + 1)]
        least = sum(sorted(edges[i + 1] - edges[i] for i in range(g))[: g - radius])
        if least * SEGMENT_ENTROPY >= need:
            break
    block = [sum(3 << (SEGMENT_BITS * s) for s in range(edges[i], edges[i + 1])) for i in range(g)]
    masks = [sum(c) for c in combinations(block, g - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _compare(tables, radius: int):
    """Edges inside each block pair: pairs in small groups, a spanning forest in large ones."""
    release_held()
    for t in tables:
        col = {c: t.column(c).to_numpy() for c in t.column_names}
        starts = group_starts([col[c] for c in ("grid", "cell", "bi", "bj")])
        fp, emb, node = col["fp"].view(np.uint64), col["emb"].view(np.uint64), col["node"]
        sizes = np.diff(starts)
        small = np.repeat(sizes <= 16, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        us, vs = [], []
        for d in range(1, min(16, len(fp))):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
            if not len(i):
                break
            i = i[np.bitwise_count(emb[i] ^ emb[i + d]) <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            us.append(node[i])
            vs.append(node[i + d])
        for s, e in zip(starts[:-1][sizes > 16], starts[1:][sizes > 16], strict=True):
            near = np.bitwise_count(emb[s:e, None] ^ emb[None, s:e]) <= radius
            near &= np.bitwise_count(fp[s:e, None] ^ fp[None, s:e]) <= radius
            root = forest(near)
            moved = np.flatnonzero(root != np.arange(e - s))
            us.append(node[s + moved])
            vs.append(node[s + root[moved]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])


def links(points: DataFrame, n: int, stages: Stages, radius: int = 3) -> DataFrame:
    """Edges (u, v) that connect all of `points` (node, fp; fp distinct) within `radius` differing bits."""
    masks = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(m).alias("mask")) for i, m in enumerate(grids(n, radius))])
    cells = (
        points.withColumn("emb", embedding(F.col("fp")))
        .withColumn("g", F.explode(masks))
        .select("node", "fp", "emb", F.col("g.grid").alias("grid"), F.col("emb").bitwiseAND(F.col("g.mask")).alias("cell"))
    )
    keys = ["grid", "cell", "bi", "bj"]
    dealt = block_pairs(cells, ["grid", "cell"], "node", BLOCK, stages).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda it: _compare(whole_groups(it, keys), radius), "u long, v long")


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(id, rid, fp) of all rows, and (fp, best) with the first row (last, id, rid) of each fingerprint's component.

    Rows of a null id come last. Fingerprints are the nodes, so that rows
    without an id link others too.
    """
    prints = stages.write(add_fingerprints(docs, id_col, text_col), "prints")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "rid")
    classes = stages.write(prints.groupBy("fp").agg(F.min(first).alias("best")), "classes")
    edges = links(classes.select(F.col("fp").alias("node"), "fp"), classes.count(), stages, radius)
    comp = connected_components(edges, stages)
    members = comp.unionByName(comp.select(F.col("v").alias("u"), "v").distinct()).withColumnRenamed("u", "fp")
    members = stages.write(members.join(classes, "fp"), "members")
    lead = stages.write(members.groupBy("v").agg(F.min("best").alias("lead")), "lead")
    led = members.join(lead, "v").select("fp", "lead")
    named = classes.join(led, "fp", "left").select("fp", F.coalesce("lead", "best").alias("best"))
    return prints, stages.write(named, "named")


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, rid, fp, component_id), the smallest id reachable by links of at most `radius` bits.

    Copies share a fingerprint and are one node, whatever their number.
    Null and empty texts have fingerprint zero; texts of any length are read
    as a whole. Rows with a null id link like others but name a component
    only (as null) where no row of it has an id; repeated rows give repeated
    rows. An empty table gives an empty result. Other columns, whatever
    their names, are ignored.
    """
    stages = Stages(docs.sparkSession, "simhash")
    prints, named = _grouped(docs, radius, id_col, text_col, stages)
    stages.keep_only("prints", "named")
    return prints.join(named, "fp", "left").select("id", "rid", "fp", F.col("best.id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of `docs` for each component: that of the smallest doc_id.

    Null ids come after all others; of different texts under one id, and of
    texts without an id, the one of least hash stays, and of equal rows any.
    Null and empty texts are one group. An empty table gives an empty
    result; all columns of the rows stay.
    """
    stages = Stages(docs.sparkSession, "simhash")
    prints, named = _grouped(docs, radius, "doc_id", "text", stages)
    rows = prints.groupBy("fp", "id", "rid").agg(F.count(F.lit(1)).alias("n")).join(named, "fp")
    stays = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.rid") == F.col("rid"))
    rows = stages.write(rows.select(F.col("id").alias("_webtel_id"), F.col("rid").alias("_webtel_rid"), "n", stays.alias("stays")), "rows")
    stages.keep_only("rows")
    keyed = docs.withColumn("_webtel_id", F.col("doc_id").cast("long"))
    keyed = keyed.withColumn("_webtel_rid", F.xxhash64("_webtel_id", F.col("text").cast("string")))

    def match(t: DataFrame) -> DataFrame:
        return small_side(t.select(F.col("_webtel_id").alias("_i"), F.col("_webtel_rid").alias("_r")), 32)

    same = F.col("_webtel_id").eqNullSafe(F.col("_i")) & (F.col("_webtel_rid") == F.col("_r"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    # Rows that stay and have equals come by another way, where all but one of them go.
    single = keyed.join(match(rows.where("not stays or n > 1")), same, "left_anti").select(*own)
    several = keyed.join(match(rows.where("stays and n > 1")), same, "left_semi").dropDuplicates(["_webtel_id", "_webtel_rid"]).select(*own)
    return single.unionByName(several)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
