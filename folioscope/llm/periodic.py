"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words with smallest period q and at least max(`MIN_WORDS`, 2 q) words that
no neighbouring word extends. Every word of a run stands in it at least twice, so:

1. Splitting: a word that stands only once in the current segment belongs to no run there and
   splits it; parts shorter than `MIN_WORDS` are dropped. This recurses until no segment has such
   a word. Whole rounds over all segments go on while each takes away an eighth of what is left;
   then single splits follow, each counting only the shorter side anew. So the work stays within
   n log n words however the splits fall.
2. Lag scan: a run of period q covers two neighbouring multiples of q that hold one word. For
   every lag those places are compared (n log n in all) and each match is extended both ways
   over blocks of 2, 4, 8, ... words known by number. A stretch found under several lags has the
   least of them as its period.

Cases: null and empty texts have no words and no run; words are compared by their bytes; runs may
overlap; null doc_ids keep their texts as they are; texts are read whole, one document at a time;
equal rows give equal rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import bounded_batches, sliced

MIN_WORDS = 12
CHUNK = 1 << 20


def stretches(alive: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of true values of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def split_rounds(ids: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Segments after rounds over all of them, and whether they are stable."""
    segments, left = [(0, len(ids))] if len(ids) >= MIN_WORDS else [], len(ids)
    kinds = int(ids.max()) + 1 if len(ids) else 1
    while segments:
        size = [b - a for a, b in segments]
        places = np.concatenate([np.arange(a, b) for a, b in segments])
        keys = np.repeat(np.arange(len(size)), size) * kinds + ids[places]
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        stays = times[which] > 1
        if stays.all():
            return segments, True
        alive = np.zeros(len(ids), bool)
        alive[places[stays]] = True
        segments = stretches(alive, MIN_WORDS)  # what lay between two of them is not alive
        now = sum(b - a for a, b in segments)
        if now > left - left // 8:
            return segments, False
        left = now
    return segments, True


def split_singly(ids: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Stable segments of [start, end). Each split counts its shorter side anew and takes it from
    the longer side's counts; words left there once are the next splits."""
    kinds = int(ids[start:end].max()) + 1
    times, places = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
    waiting, found = [(start, end)], []
    while waiting:
        a, b = waiting.pop()
        if b - a < MIN_WORDS:
            continue
        np.add.at(times, ids[a:b], 1)
        np.add.at(places, ids[a:b], np.arange(a, b))
        once = np.flatnonzero(times[ids[a:b]] == 1) + a
        splits = once.tolist()
        while splits and b - a >= MIN_WORDS:
            at = splits.pop()
            if not a <= at < b:
                continue  # lies on a side already cut off
            low, high = (a, at + 1) if at - a < b - at else (at, b)
            side = ids[low:high]
            np.subtract.at(times, side, 1)
            np.subtract.at(places, side, np.arange(low, high))
            waiting.append((a, at) if low == a else (at + 1, b))
            a, b = (high, b) if low == a else (a, low)
            fewer = np.unique(side)
            splits += places[fewer[times[fewer] == 1]].tolist()
        if b - a >= MIN_WORDS:
            found.append((a, b))
        times[ids[a:b]] = 0
        places[ids[a:b]] = 0
    return sorted(found)


def surviving(ids: np.ndarray) -> list[tuple[int, int]]:
    """Segments in which every word stands at least twice."""
    segments, stable = split_rounds(ids)
    return segments if stable else [s for a, b in segments for s in split_singly(ids, a, b)]


def block_numbers(ids: np.ndarray) -> list[np.ndarray]:
    """Numbers of the blocks of 1, 2, 4, ... words at each place: equal numbers, equal words."""
    numbers = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while 2 * width <= len(ids):
        last = numbers[-1]
        pairs = last[:len(ids) - 2 * width + 1] * (int(last.max()) + 1) + last[width:len(ids) - width + 1]
        numbers.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return numbers


def extended(numbers: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the words before, and from, places a < b agree."""
    n = len(numbers[0])
    ahead, behind = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(numbers) - 1, -1, -1):
        width, level = 1 << k, numbers[k]
        i, j = a + ahead, b + ahead
        fits = np.flatnonzero(j + width <= n)
        ahead[fits[level[i[fits]] == level[j[fits]]]] += width
        i, j = a - behind - width, b - behind - width
        fits = np.flatnonzero(i >= 0)
        behind[fits[level[i[fits]] == level[j[fits]]]] += width
    return behind, ahead


def segment_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs of a sequence, by start and period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    numbers = block_numbers(ids)
    found: dict[tuple[int, int], int] = {}
    lag = 1
    while lag <= n // 2:
        last, size = lag, (n - 1) // lag
        while last < n // 2 and size < CHUNK:
            last += 1
            size += (n - 1) // last
        lags = np.arange(lag, last + 1)
        checks = (n - 1) // lags
        q = np.repeat(lags, checks)
        a = (np.arange(len(q)) - np.repeat(np.cumsum(checks) - checks, checks)) * q
        same = numbers[0][a] == numbers[0][a + q]
        a, q = a[same], q[same]
        behind, ahead = extended(numbers, a, a + q)
        length = q + behind + ahead
        good = length >= np.maximum(MIN_WORDS, 2 * q)
        for start, size, period in np.unique(np.stack([a[good] - behind[good], length[good], q[good]], axis=1), axis=0).tolist():
            found.setdefault((start, size), period)  # lags ascend, within and between chunks
        lag = last + 1
    return sorted((start, size, period) for (start, size), period in found.items())


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, by start and period."""
    out = [(a + start, size, period) for a, b in surviving(ids) for start, size, period in segment_runs(ids[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def tiled(doc_id, words: list[bytes]) -> list[bytes]:
    """The query's rewriting: in a tenth of the documents the words from some place on repeat."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def described(words: list[bytes]) -> tuple:
    """SCHEMA's values of a text."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    runs = runs_of(ids)
    gone = np.zeros(len(words), bool)
    for start, size, period in runs:
        gone[start + period:start + size] = True
    kept = b" ".join(words if not runs else [w for w, g in zip(words, gone.tolist()) if not g])
    listed = "".join(f"{start},{size},{period}\n" for start, size, period in runs)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
            [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], kept.decode("utf-8", "surrogatepass"))


def periodic_runs(documents: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, texts: bool = True) -> DataFrame:
    """A row for each document: doc_id, its runs and longest run, digests and, with `texts`, the
    text without its repetitions. rewrite: changes the words of a document first."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                rows.append(described(rewrite(doc, words) if rewrite else words))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 3 + [pa.string()]
            columns = [pa.array(c if texts or name != "collapsed" else [None] * len(rows), kind) for c, kind, name in zip(zip(*rows), kinds, names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")
