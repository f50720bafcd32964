"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to their bit counts, a point
of the grid {0, 1, 2}^32. The Manhattan distance of two points never exceeds the Hamming distance
of the fingerprints. Counts are kept in a unary code (0, 1, 2 -> 00, 01, 11), so the Manhattan
distance is the popcount of an exclusive or and everything stays in built-in functions.

Grid join: the 32 coordinates are dealt to `GROUPS` = 7 groups. Points at Manhattan distance at
most 4 differ in at most four groups and so agree in three: each point is entered into the grid
cells of all C(7, 3) = 35 triples of groups, cells are equi-joined, a pair counts only in the
cell of its three lowest equal groups (so once), and is checked for Manhattan and then exact
Hamming distance inside the join. A cell of more than `HOT_CELL` different fingerprints is not
paired: its members enter every point within Hamming distance 2 instead, and fingerprints that
meet in such a point (exactly those at distance 4 or less) are linked to the smallest one there,
which is linear in the cell.

Equal fingerprints are one node, so copies are never paired. Components come from alternating
large-star and small-star steps, each written to the shared folder. Tables that grow with the
documents are joined by merging: what is broadcast is gathered by the driver first, and Spark takes
the 35 cells of a fingerprint for one when it sizes a table.

Cases: null and empty texts have fingerprint 0 and are linked like any other; texts are read
whole; equal rows and repeated doc_ids are rows of their own with one component; null doc_ids
take part, but name a component only if no other member has an id; an empty table gives no row;
`documents` may have any other columns, `near_distinct` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import bounded_batches, texts_of, worker_kept
from folioscope.session import staged

SHINGLE, SEED, MAX_BITS = 4, 42, 4
GROUPS = 7
HOT_CELL = 4096

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 bits of all word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    stops = ends[shingle - 1:].tolist()
    for i in range(0, len(stops), 1 << 16):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + (1 << 16)], stops[i:i + (1 << 16)])], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(stops), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_column(texts: pa.Array) -> pa.Array:
    """Fingerprints with their 64 bits in a signed long."""
    worker_kept("fingerprints", dict)  # lets go of what an earlier stage left in the worker
    return pa.array(np.array([fingerprint(t) for t in texts_of(texts)], np.uint64).view(np.int64))


def embedded(fp: Column) -> Column:
    """Segment bit counts in unary code."""
    even = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(high).bitwiseAND(even)
    both = fp.bitwiseAND(high).bitwiseAND(even)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _group_masks() -> list[int]:
    return [_signed(sum(3 << (2 * int(s)) for s in part)) for part in np.array_split(np.arange(32), GROUPS)]


def _cells(nodes: DataFrame) -> DataFrame:
    """(triple, cell, fp, e): each fingerprint in its 35 cells; triple is a bitmap of groups."""
    masks = _group_masks()
    entries = []
    for groups in combinations(range(GROUPS), GROUPS - MAX_BITS):
        whole = reduce(lambda a, b: a | b, (masks[g] for g in groups))
        entries.append(F.struct(F.lit(sum(1 << g for g in groups)).alias("triple"), F.col("e").bitwiseAND(F.lit(whole)).alias("cell")))
    wide = nodes.select("fp", embedded(F.col("fp")).alias("e"))
    return wide.select("fp", "e", F.explode(F.array(*entries)).alias("x")).select("x.triple", "x.cell", "fp", "e")


def _lowest_equal(a: Column, b: Column) -> Column:
    """Bitmap of the three lowest groups in which two points agree."""
    diff = a.bitwiseXOR(b)
    equal = reduce(lambda x, y: x.bitwiseOR(y), [F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(1 << g)).otherwise(F.lit(0)) for g, m in enumerate(_group_masks())])
    found = F.lit(0)
    for _ in range(GROUPS - MAX_BITS):
        lowest = equal.bitwiseAND(-equal)
        found, equal = found.bitwiseOR(lowest), equal.bitwiseXOR(lowest)
    return found


def _ball_points(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every point within Hamming distance 2 of a fingerprint."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    steps = np.concatenate([np.zeros(1, np.uint64), bits, bits[i] | bits[j]])
    for batch in rows:
        for fp in batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64):
            points = np.array([fp], np.int64).view(np.uint64) ^ steps
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(steps), fp, np.int64)), pa.array(points.view(np.int64))], ["fp", "point"])


def links(nodes: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b), a < b: linked fingerprints of the distinct column fp. Complete for cells up to
    hot_cell members; members of larger cells are linked to the smallest fingerprint of each
    point they share, which leaves the same components."""
    cells = _cells(nodes)
    sizes = cells.groupBy("triple", "cell").agg(F.count(F.lit(1)).alias("n"))
    hot = staged(sizes.where(F.col("n") > hot_cell).select("triple", "cell"), "hot-cells")
    crowded = not hot.isEmpty()
    inside = cells.join(hot, ["triple", "cell"], "left_anti") if crowded else cells
    a, b = inside.alias("a"), inside.alias("b")
    near = (
        (F.col("a.triple") == F.col("b.triple")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= MAX_BITS)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
        & (_lowest_equal(F.col("a.e"), F.col("b.e")) == F.col("a.triple"))
    )
    pairs = a.join(b.hint("merge"), near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not crowded:
        return pairs
    members = cells.join(hot, ["triple", "cell"], "left_semi").select("fp").distinct()
    points = members.mapInArrow(_ball_points, "fp long, point long")
    first = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = points.join(first.hint("merge"), "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node of its component."""
    edges = staged(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "edges")

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def clusters(prints: DataFrame) -> DataFrame:
    """From (doc_id, fp), a row for each document: adds component_id, the smallest doc_id
    reachable over links."""
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = staged(components(links(first.select("fp"))).distinct(), "roots")
    named = roots.join(first.hint("merge"), roots["node"] == first["fp"]).select("node", "root", "first")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = named.join(lowest.hint("merge"), "root").select(F.col("node").alias("fp"), "component_id")
    labels = first.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(labels.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_clusters(documents: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    return clusters(staged(bounded_batches(documents).select("doc_id", fingerprint_column("text").alias("fp")), "doc-prints"))


def near_distinct(documents: DataFrame) -> DataFrame:
    """documents with one row of each component: one with the smallest doc_id."""
    found = staged(near_clusters(documents.select("doc_id", "text")), "doc-clusters")
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counts = staged(firsts.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")), "survivors")
    counts = counts.withColumnsRenamed({"doc_id": "_keep_id", "fp": "_keep_fp"})
    ids = counts.groupBy("_keep_id").agg(F.sum("n").alias("rows"), F.first("_keep_fp").alias("_keep_fp"))
    marked = documents.withColumn("_fp", fingerprint_column("text"))
    same = marked["doc_id"].eqNullSafe(F.col("_keep_id")) & (marked["_fp"] == F.col("_keep_fp"))
    single = marked.join(ids.where("rows = 1").hint("merge"), same, "left_semi").drop("_fp")
    more = ids.where("rows > 1").select(F.col("_keep_id").alias("_many_id"))
    if more.isEmpty():
        return single
    several = counts.join(more.hint("merge"), F.col("_keep_id").eqNullSafe(F.col("_many_id")), "left_semi")
    repeated = marked.join(several.hint("merge"), same, "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "_fp"]).drop("_fp"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
