"""Benchmark decontamination by spaced-seed hashing.

Words (runs of word characters, lower case) of both sides are hashed under fixed masks that
ignore some positions. A benchmark item and a document match if, without gaps, some window of
`WINDOW` = 15 words (the whole item if it is shorter) agrees in at least four of five words. The
masks are lossless for that: whichever words of a window are substituted, some mask has a place
inside it that only touches agreeing words (`tests/llm` tries all patterns).

The documents are scanned once against a Bloom filter of the benchmark's hashes, whose size is
bounded (`MAX_FILTER_BITS`; a fuller filter lets more through and changes no result). What passes is
written with the words around it, joined with the benchmark's hashes, and each (place, item,
diagonal) is verified word by word.

Cases: items under `SHORTEST` = 5 words are too short to be evidence and match nothing; null and
empty texts have no words; ids may be null or repeated (a document is told apart by id and text);
empty tables give no match; other columns are ignored by `matches` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_batches, sliced, worker_kept
from folioscope.session import staged

WINDOW, SHORTEST, MAX_FILTER_BITS = 15, 5, 30

#: Masks by the least and most words of the items they serve; 1 is compared, 0 ignored.
MASKS = [
    (15, None, ["1111011", "11001000111", "11010110001"]),
    (10, 14, ["11111", "111011", "11010011"]),
    (5, 9, ["111", "1101"]),
]
ALL_MASKS = [m for _, _, masks in MASKS for m in masks]
SPAN = max(map(len, ALL_MASKS))

WORDS = re.compile(r"\w+")
REMEMBERED = 200_000
#: Keys of a benchmark that may be sent to every task; it has fewer words than twice as many.
SENT_KEYS = 100_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def word_hashes() -> WordHashes:
    return worker_kept("word hashes", WordHashes)


def hashed_words(text: str | None) -> np.ndarray:
    words = WORDS.findall((text or "").lower())
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def seed_keys(words: np.ndarray, mask: int) -> np.ndarray:
    """The key of every place of a mask in a sequence of word hashes."""
    pattern = ALL_MASKS[mask]
    n = len(words) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, mask + 1, np.uint64)
    for offset, used in enumerate(pattern):
        if used == "1":
            key = (key ^ words[offset:offset + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key


def needed(n_words: int) -> tuple[int, int]:
    """Window and the words of it that must agree, for an item of that many words."""
    window = min(WINDOW, n_words)
    return window, window - window // 5


def item_keys(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, words) and (key, item, place) of the benchmark. item is a number of its own."""
    plain = staged(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [hashed_words(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), pa.array(found, pa.list_(pa.int64()))], ["item_id", "item", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    hashed = staged(plain.mapInArrow(words, f"item_id {kind}, item long, words array<long>"), "item-words")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for item, listed in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                seq = np.array(listed, np.int64).view(np.uint64)
                for low, high, masks in MASKS:
                    if low <= len(seq) <= (high or len(seq)):
                        for pattern in masks:
                            key = seed_keys(seq, ALL_MASKS.index(pattern)).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), item, np.int64)), pa.array(np.arange(len(key), dtype=np.int32))], ["key", "item", "place"])

    return hashed, staged(hashed.mapInArrow(keys, "key long, item long, place int"), "item-keys")


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a filter of 2 ** bits bits."""
    shift = np.uint64(64 - bits)
    return keys >> shift, (keys * np.uint64(0xD6E8FEB86659FD93)) >> shift


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter, packed: tasks set bits in pages of 64 Kbit, pages are merged by number. Only
    its bounded bytes reach the driver."""
    page = min(bits, 16)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            seq = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for places in _places(seq, bits):
                for number in np.unique(places >> np.uint64(page)).tolist():
                    mine = places[places >> np.uint64(page) == number] & np.uint64((1 << page) - 1)
                    filled.setdefault(number, np.zeros(1 << page, bool))[mine.astype(np.int64)] = True
        for number, flags in filled.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["page", "flags"])

    def merged(table: pa.Table) -> pa.Table:
        flags = np.bitwise_or.reduce([np.frombuffer(f, np.uint8) for f in table.column("flags").to_pylist()])
        return pa.table({"page": [table.column("page")[0].as_py()], "flags": pa.array([flags.tobytes()], pa.binary())})

    whole = np.zeros(1 << max(0, bits - 3), np.uint8)
    size = (1 << page) // 8
    for row in keys.mapInArrow(pages, "page long, flags binary").groupBy("page").applyInArrow(merged, "page long, flags binary").toLocalIterator():
        whole[row["page"] * size:(row["page"] + 1) * size] = np.frombuffer(bytes(row["flags"]), np.uint8)
    return whole


def seed_hits(documents: DataFrame, filter_bytes: np.ndarray, bits: int, masks: list[int]) -> DataFrame:
    """Stretches of documents around places whose key is in the filter: place (a number of its
    own), doc_id, mark (hash of the text), start, words and the hits in them."""
    shared = documents.sparkSession.sparkContext.broadcast(filter_bytes)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        flags, hashes = shared.value, word_hashes()
        for batch in sliced(batches):
            found = [WORDS.findall(t.lower()) if t else [] for t in batch.column("text").to_pylist()]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.cumsum(lengths)
            everything = np.fromiter((hashes[w] for doc in found for w in doc), np.uint64, int(lengths.sum()))
            at, keys = [], []
            for mask in masks:
                key = seed_keys(everything, mask)
                first, second = _places(key, bits)
                hit = np.flatnonzero((flags[first >> np.uint64(3)] >> (~first & np.uint64(7)).astype(np.uint8)) & 1)
                other = second[hit]
                hit = hit[((flags[other >> np.uint64(3)] >> (~other & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                inside = hit + len(ALL_MASKS[mask]) <= ends[np.searchsorted(ends, hit, "right")] if len(hit) else hit.astype(bool)
                hit = hit[inside]
                at.append(hit)
                keys.append(key[hit])
            at, keys = np.concatenate(at), np.concatenate(keys)
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            docs = np.searchsorted(ends, at, "right")
            cut = np.flatnonzero((np.diff(at) > 2 * WINDOW + SPAN) | (np.diff(docs) > 0)) + 1
            rows = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                if a == b:
                    continue
                doc = int(docs[a])
                low = max(int(at[a]) - WINDOW, int(ends[doc] - lengths[doc]))
                high = min(int(at[b - 1]) + SPAN + WINDOW, int(ends[doc]))
                hits = [{"offset": o, "key": k} for o, k in zip((at[a:b] - low).tolist(), keys[a:b].view(np.int64).tolist())]
                rows.append((number, doc, low - int(ends[doc] - lengths[doc]), everything[low:high].view(np.int64), hits))
                number += 1
            docs_at = pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), batch.column("doc_id").take(docs_at), batch.column("mark").take(docs_at),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                pa.array([r[4] for r in rows], pa.list_(pa.struct([("offset", pa.int32()), ("key", pa.int64())]))),
            ], ["place", "doc_id", "mark", "start", "words", "hits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    marked = bounded_batches(documents).select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(stretches, f"place long, doc_id {kind}, mark long, start long, words array<long>, hits array<struct<offset: int, key: long>>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "mark", "item_id", "matched", "item_words", "word_start", "word_end"]
    for batch in sliced(batches):
        rows = []
        for i, (start, diagonal, ours, theirs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "diagonal", "words", "item_words")))):
            a, b = np.array(ours), np.array(theirs)
            low, high = max(0, -diagonal), min(len(b), len(a) - diagonal)
            window, least = needed(len(b))
            if high - low < window:
                continue
            same = a[low + diagonal:high + diagonal] == b[low:high]
            sums = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(sums[window:] - sums[:-window] >= least)
            if len(good):
                covered = np.zeros(len(same), bool)
                for g in good.tolist():
                    covered[g:g + window] = True
                spots = np.flatnonzero(covered & same)
                rows.append((i, int(len(spots)), len(b), start + low + diagonal + int(spots[0]), start + low + diagonal + int(spots[-1]) + 1))
        took = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(took) for c in names[:3]] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)], names)


def matches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that match: doc_id, mark, item_id, matched (words of the
    item found at their place, the best diagonal), item_words, word_start and word_end."""
    words, keys = item_keys(items)
    n = keys.count()
    bits = min(MAX_FILTER_BITS, max(16, (256 * max(1, n) - 1).bit_length()))
    sizes = words.agg(*[F.max(F.size("words").between(low, high or 1 << 30)).alias(f"m{k}") for k, (low, high, _) in enumerate(MASKS)]).first()
    used = [ALL_MASKS.index(m) for k, (_, _, masks) in enumerate(MASKS) if sizes[k] for m in masks] or [0]
    places = staged(seed_hits(documents, bloom(keys, bits), bits, used), "seed-hits")
    hits = places.select("place", F.explode("hits").alias("x")).select("place", "x.offset", "x.key")
    # What follows from the documents is never broadcast: Spark sizes exploded rows as one a list.
    side = "broadcast" if n <= SENT_KEYS else "merge"
    found = hits.join(keys.withColumnRenamed("place", "spot").hint(side), "key").select(
        "place", "item", (F.col("offset") - F.col("spot")).alias("diagonal")).distinct()
    around = places.select("place", "doc_id", "mark", "start", "words").hint("merge")
    whole = found.join(around, "place").join(
        words.where(F.size("words") >= SHORTEST).select("item", "item_id", F.col("words").alias("item_words")).hint(side), "item")
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((documents, "doc_id"), (items, "item_id")))
    rows = whole.select("doc_id", "mark", "item_id", "start", "diagonal", "words", "item_words").mapInArrow(
        _verified, f"doc_id {doc_kind}, mark long, item_id {item_kind}, matched long, item_words long, word_start long, word_end long")
    return rows.groupBy("doc_id", "mark", "item_id").agg(
        F.max("matched").alias("matched"), F.max("item_words").alias("item_words"),
        F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents without those that match an item."""
    bad = staged(matches(documents, items).select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct(), "contaminated")
    marked = documents.withColumn("_mark", F.xxhash64("text"))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["_bad_id"]) & (marked["_mark"] == bad["_bad_mark"]), "left_anti").drop("_mark")
