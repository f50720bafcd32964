"""Ranked lexical search over K2-treaps.

An index shard is a grid of terms (rows) by documents (columns) as a compressed quadtree: every
node that is not empty has a mask of its four children and the largest impact below it (rounded
up to `STEP`), a cell its exact term frequency. Levels are laid out one after the other, so the
children of a node stand together at a place found by counting bits. Rows are ordered from common
to rare terms, so that the rare ones share sparse blocks; columns ascend by doc_id.

Search: the paths of all terms of an item descend together. A node of the search is a range of
documents with the quadtree node of each term on its row; the sum of weight x maximum bounds the
score of every document in it. The ranges of highest bound are opened first, `OPENED` an item at
a time and `GROUP` items side by side, until no range can reach the worst of the best `k`.

Score of a document: sum over an item's terms, repeats included, of w * ((10**9 tf) div
(1000 tf + 12 m)) with m = 75 + (25 n N) div L; see `Totals`. Scores are sums of whole numbers
below 2**53.

Totals are counted first; shards are then built where the texts are read, of about `SHARD_WORDS`
words, and written once. Items are taken in blocks of `ITEM_BLOCK` (a stated query set): only a
block's distinct terms and weights are sent to tasks, and every shard returns at most k rows an
item.

Cases: null and empty texts have no terms and take no part; rows of documents with one doc_id are
ranked each for itself (null ids last among equal scores); rows of items with one item_id are one
item whose terms add up; an item without terms, or whose terms no document holds, has no row; an
empty table gives no row; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_batches, global_order, sliced
from folioscope.session import staged

SHARD_WORDS, ITEM_BLOCK = 1 << 21, 256
OPENED, GROUP = 48, 16
STEP = 16
#: Lower-cases A-Z; all other ASCII than letters and digits parts terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: BELOW[mask, quadrant]: children of a mask before a quadrant.
BELOW = np.array([[(mask & (1 << q) - 1).bit_count() for q in range(4)] for mask in range(16)], np.int64)
ONES = np.array([mask.bit_count() for mask in range(16)], np.int64)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass(frozen=True)
class Totals:
    """documents with a term, and terms of all documents."""

    documents: int
    terms: int

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        return 75 + (25 * sizes * self.documents) // max(1, self.terms)


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norms)


def totals(documents: DataFrame) -> Totals:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    n = len(terms_of(text))
                    docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])

    parts = bounded_batches(documents).select("text").mapInArrow(count, "docs long, terms long")
    row = parts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Totals(*row)


# -- the quadtree ----------------------------------------------------------------------------------

def spread(x: np.ndarray) -> np.ndarray:
    """The low 31 bits of each number at the even places."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


@dataclass
class Treap:
    """Nodes of all levels, from the root to the cells; the cells have frequencies."""

    levels: list[int]  # nodes of each level; the last one counts cells
    masks: np.ndarray
    maxima: np.ndarray  # in STEPs
    frequencies: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> Treap:
        """Of cells (row, column), each once."""
        depth = int(max(rows.max(), columns.max())).bit_length()
        codes = spread(rows) << 1 | spread(columns)
        order = np.argsort(codes, kind="stable")
        codes, value = codes[order], impact[order]
        masks, maxima, levels = [], [], [len(codes)]
        for _ in range(depth):
            up = codes >> 2
            starts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            masks.append(np.add.reduceat(1 << (codes & 3), starts).astype(np.uint8))
            value = np.maximum.reduceat(value, starts)
            maxima.append((-(-value // STEP)).astype(np.uint16))
            codes = up[starts]
            levels.append(len(codes))
        none = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint16)]
        return Treap(levels[::-1], np.concatenate(masks[::-1] or none[0]), np.concatenate(maxima[::-1] or none[1]), tf[order].astype(np.uint32))

    def packed(self) -> list[bytes]:
        codec = pa.Codec("zstd")
        return [codec.compress(part.tobytes(), asbytes=True) for part in (self.masks, self.maxima, self.frequencies)]

    @staticmethod
    def unpacked(levels: list[int], masks: bytes, maxima: bytes, frequencies: bytes) -> Treap:
        codec = pa.Codec("zstd")
        inner = sum(levels[:-1])
        parts = [np.frombuffer(codec.decompress(raw, n * np.dtype(kind).itemsize, asbytes=True), kind)
                 for raw, n, kind in ((masks, inner, np.uint8), (maxima, inner, np.uint16), (frequencies, levels[-1], np.uint32))]
        return Treap(levels, *parts)

    def first_children(self) -> np.ndarray:
        """Place of each inner node's first child: one after all children of the nodes before."""
        count = ONES[self.masks]
        return 1 + np.cumsum(count) - count


@dataclass
class Frontier:
    """Ranges of documents that wait: item, level, column block, bound and their row paths."""

    item: np.ndarray
    level: np.ndarray
    column: np.ndarray
    bound: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def where(self, keep: np.ndarray) -> Frontier:
        return Frontier(*(c[keep] for c in vars(self).values()))

    def joined(self, other: Frontier) -> Frontier:
        return Frontier(*(np.concatenate(pair) for pair in zip(vars(self).values(), vars(other).values())))


def rank_in(groups: np.ndarray) -> np.ndarray:
    """Place of each element in its group; equal groups stand together."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))


def best_documents(tree: Treap, norms: np.ndarray, items: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(item, column, score) of the k best documents of each item 0, 1, ... and, of equal scores,
    the lowest columns. Path i belongs to items[i] and follows rows[i] with weights[i]."""
    n_items, depth, cells = int(items.max()) + 1, len(tree.levels) - 1, sum(tree.levels[:-1])
    children = tree.first_children()
    kth = np.ones(n_items)  # a bound below it is of no use
    top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(items, kind="stable")
    paths, nodes, used = order.copy(), np.zeros(len(order), np.int64), len(order)
    some, start, size = np.unique(items[order], return_index=True, return_counts=True)
    zeros = np.zeros(len(some), np.int64)
    front = Frontier(some, zeros, zeros, np.full(len(some), np.inf), start, size)
    if not depth:  # a single cell
        score = np.bincount(items, weights * impacts(tree.frequencies[:1].astype(np.int64), norms[:1])[0], n_items)
        found = np.flatnonzero(score > 0)
        return found, np.zeros(len(found), np.int64), score[found]
    while len(front.item):
        order = np.lexsort((-front.bound, front.item))
        chosen = np.zeros(len(order), bool)
        chosen[order] = rank_in(front.item[order]) < OPENED
        opened, front = front.where(chosen), front.where(~chosen)
        n = len(opened.item)
        of = np.repeat(np.arange(n), opened.size)
        at = np.arange(len(of)) + np.repeat(opened.start - np.cumsum(opened.size) + opened.size, opened.size)
        path, node, level = paths[at], nodes[at], opened.level[of]
        mask, half = tree.masks[node], 2 * (rows[path] >> (depth - 1 - level) & 1)
        parts = []
        for b in (0, 1):
            quadrant = half + b
            there = np.flatnonzero(mask >> quadrant & 1)
            parts.append((2 * of[there] + b, path[there], children[node[there]] + BELOW[mask[there], quadrant[there]]))
        child, path, node = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(child, kind="stable")
        child, path, node = child[order], path[order], node[order]
        column, leaf = 2 * opened.column[child >> 1] + (child & 1), node >= cells
        value = np.empty(len(node), np.int64)
        value[~leaf] = tree.maxima[node[~leaf]].astype(np.int64) * STEP
        value[leaf] = impacts(tree.frequencies[node[leaf] - cells].astype(np.int64), norms[column[leaf]])
        bound = np.bincount(child, weights[path] * value, 2 * n)
        made, start, size = np.unique(child, return_index=True, return_counts=True)
        item, bound, column, last = opened.item[made >> 1], bound[made], column[start], leaf[start]
        fits = bound >= kth[item]
        done = fits & last
        if done.any():
            merged = [np.concatenate(pair) for pair in zip(top, (item[done], column[done], bound[done]))]
            order = np.lexsort((merged[1], -merged[2], merged[0]))
            rank = rank_in(merged[0][order])
            top = tuple(c[order[rank < k]] for c in merged)
            full = order[rank == k - 1]
            kth[merged[0][full]] = merged[2][full]
        on = fits & ~last
        if on.any():
            if used + len(path) > len(paths):
                room = used + len(path)
                paths, nodes = (np.concatenate([c, np.zeros(room, np.int64)]) for c in (paths, nodes))
            paths[used:used + len(path)], nodes[used:used + len(path)] = path, node
            front = front.joined(Frontier(item[on], opened.level[made[on] >> 1] + 1, column[on], bound[on], start[on] + used, size[on]))
            used += len(path)
        front = front.where(front.bound >= kth[front.item])
    return top


# -- shards ----------------------------------------------------------------------------------------

class Numbers(dict):
    """term -> number in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def index_shards(documents: DataFrame, known: Totals) -> DataFrame:
    """Index shards of all documents: ids and sizes of their columns, terms and their document
    counts by row, and the quadtree."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids_type = documents.select("doc_id").schema["doc_id"].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(ids_type)
        numbers, held, ids, n_words = Numbers(), [], [], 0

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            sizes = np.array([len(held[i]) for i in order], np.int64)
            words = np.concatenate([held[i] for i in order])
            keys, tf = np.unique(words * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
            number, column = keys // len(sizes), keys % len(sizes)
            df = np.bincount(number, minlength=len(numbers))
            by_row = np.argsort(-df, kind="stable")
            row_of = np.empty(len(df), np.int64)
            row_of[by_row] = np.arange(len(df))
            tree = Treap.build(row_of[number], column, tf, impacts(tf, known.norms(sizes)[column]))
            terms = pa.array(numbers, pa.binary()).take(pa.array(by_row))
            masks, maxima, frequencies = tree.packed()
            columns = [pa.array([[ids[i] for i in order]], pa.list_(arrow)), pa.array([sizes], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), terms),
                       pa.array([df[by_row]], pa.list_(pa.int64())), pa.array([tree.levels], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (masks, maxima, frequencies))]
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "sizes", "terms", "counts", "levels", "masks", "maxima", "frequencies"])

        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                terms = terms_of(text)
                if terms:
                    held.append(np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)))
                    ids.append(doc)
                    n_words += len(terms)
                if n_words >= SHARD_WORDS:
                    yield flush()
                    numbers.clear()
                    held, ids, n_words = [], [], 0
        if ids:
            yield flush()

    schema = (f"doc_ids array<{kind}>, sizes array<long>, terms array<binary>, counts array<long>, levels array<long>, "
              "masks binary, maxima binary, frequencies binary")
    return staged(bounded_batches(documents).select("doc_id", "text").mapInArrow(build, schema), "k2-shards")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            terms = [terms_of(t) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), pa.array([x for t in terms for x in t], pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, term binary")
    return rows.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def weighted_terms(shards: DataFrame, terms: DataFrame, known: Totals) -> DataFrame:
    """(item_id, term, weight): weight x times of the items' terms that a document holds."""
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    wanted = terms.select("term").distinct()
    df = held.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * known.documents + 2) / (2 * F.col("df") + 1)))
    return terms.join(df, "term").select("item_id", "term", (weight * F.col("times")).cast("long").alias("weight"))


def shard_hits(shards: DataFrame, block: pa.Table, known: Totals, k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents of each shard for a block of items. block:
    (item, term, weight) in order of item."""
    doc_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_ids", "sizes", "terms", "levels", "masks", "maxima", "frequencies"]
    sent = shards.sparkSession.sparkContext.broadcast((block["item"].to_numpy(), block["term"].combine_chunks(), block["weight"].to_numpy()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                parts = {c: batch.column(c)[i] for c in names}
                row = pc.index_in(terms, value_set=parts["terms"].values)
                here = np.flatnonzero(row.is_valid().to_numpy(zero_copy_only=False) & (weights > 0))
                rows = row.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int64)
                tree = Treap.unpacked(parts["levels"].as_py(), *(parts[c].as_py() for c in ("masks", "maxima", "frequencies")))
                norms = known.norms(parts["sizes"].values.to_numpy())
                which, item = np.unique(items[here], return_inverse=True)
                for first in range(0, len(which), GROUP):
                    mine = (item >= first) & (item < first + GROUP)
                    number, column, score = best_documents(tree, norms, item[mine] - first, rows[mine], weights[here[mine]], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which[first + number]), parts["doc_ids"].values.take(pa.array(column)), pa.array(score.astype(np.int64))], ["item", "doc_id", "score"])

    return shards.select(*names).mapInArrow(search, f"item long, doc_id {doc_type}, score long")


def ranked(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    known = totals(documents)
    shards = index_shards(documents, known)
    weighted = staged(weighted_terms(shards, item_terms(items), known), "item-terms")
    numbered = staged(global_order(weighted.select("item_id").distinct(), [F.col("item_id").asc_nulls_last()], "item", "items"), "item-numbers")
    placed = staged(weighted.withColumnRenamed("item_id", "_id").join(numbered, F.col("_id").eqNullSafe(F.col("item_id"))).select("item", "term", "weight"), "item-weights")
    hits = None
    for first in range(0, numbered.count(), ITEM_BLOCK):
        block = placed.where((F.col("item") >= first) & (F.col("item") < first + ITEM_BLOCK)).toArrow().sort_by("item")
        found = shard_hits(shards, block, known, k)
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        kind = documents.schema["doc_id"].dataType.simpleString()
        hits = documents.sparkSession.createDataFrame([], f"item long, doc_id {kind}, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(numbered, "item").select("item_id", "rank", "doc_id", "score")
