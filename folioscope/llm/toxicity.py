"""Toxicity by maximum-scoring segments over token log-odds.

1. Counts: every text is cut into words; a word and its first five and four characters are three
   features, each counted under its own 64-bit hash. Tasks count the documents that hold a
   feature, among toxic and other labelled ones in two folds, then, for the features known from
   `ENOUGH` of those, among all documents. A fit reads `LABELLED` labelled ids at most. Near copies share one vote: documents with one label and the same
   smallest hash of a word triple divide it, or a toxic text's copies would make its whole
   wording look toxic.
2. Weights: log-odds of a feature between the two classes under a Dirichlet prior (`FLAT` of a
   document for each of `POSSIBLE` features and the corpus counts, scaled to `PRIOR` of the
   labelled ones), less `CAUTION` standard errors. A word weighs what its most special feature known from `ENOUGH` labelled documents does, at
   least `FLOOR`, less `DRIFT`, so that a stretch of neutral words scores below zero.
3. Segments: one linear scan over the scores of all words, repeated ones too, finds all disjoint
   maximal-scoring segments of a text. That words come in runs is met by step 4, whose fits see
   ordinary texts scored in the same way.
4. Extreme values: the best segment of n words of ordinary text exceeds s with probability
   1 - exp(-K n exp(-lambda s)); K and lambda are fitted to the learnable rows that aren't toxic,
   as are the two parameters that turn the evidence of a text's significant segments into a
   probability. Both fits see binned sums of the labelled rows, a bounded table, and score a row
   with weights learned from the other fold, so that it doesn't vouch for itself.

What reaches the driver and is broadcast are the features known from `ENOUGH` labelled documents
(8 bytes each) and, with their weights (20 bytes), those that weigh more than `FLOOR` or may hide
a shorter one (they begin alike); all others weigh `FLOOR` anyway. `LABELLED` bounds both. Beside
them only the bins reach the driver.

Cases: null and empty texts have no segments and get the score of no evidence; null ids count as
the empty text in the split; several labels of one id count as toxic if one is; without labels
of both classes all scores are 0; texts are read whole; equal rows give equal scores; an empty
table gives no row; other columns are ignored by `scored` and kept by `clean`.
"""

from __future__ import annotations

import math
import string
import uuid
from array import array
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import bounded_batches, kept_beside, sliced, texts_of, worker_kept
from folioscope.llm.decontam import word_hashes
from folioscope.session import staged

POSSIBLE, ENOUGH, OWN_BITS = 1 << 20, 5, 40
PRIOR, FLAT, CAUTION, FLOOR, DRIFT, CEILING = 0.002, 0.5, 2.0, -1.0, 0.1, 8.0
CLASSES = 5  # all; toxic and other of fold 0; toxic and other of fold 1
LEARNED = (((1, 3), (2, 4)), ((3,), (4,)), ((1,), (2,)))  # toxic and other: both folds, without fold 0, without fold 1
SIGNIFICANT = 0.05
REMEMBERED, BEGINNINGS, FLUSH = 400_000, 150_000, 150_000
TOGETHER = 64  # texts whose words are looked up together
LABELLED = 200_000  # most labelled ids a fit reads
REJECT = 0.7
MARKS = string.punctuation + "«»“”‘’„…—–¡¿"


def learnable() -> Column:
    """Rows whose labels may be used."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fold() -> Column:
    return F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / 3) % 2


class Beginnings(dict):
    """beginning of a word -> hash, kept up to BEGINNINGS."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, part: str) -> int:
        if len(self) >= BEGINNINGS:
            self.clear()
        self[part] = h = xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), self.seed)
        return h


def features_of(words: Collection[str]) -> np.ndarray:
    """A row for each word: hashes of the word, its first five and its first four characters, without
    marks at its ends. All three begin with the same 24 bits, those of the first four characters' hash."""
    fives, fours = kept_beside("beginnings", lambda: (Beginnings(2), Beginnings(3)))
    digest, n = xxhash.xxh64_intdigest, len(words)
    bare = [w.strip(MARKS) or w for w in words]
    whole = np.fromiter((digest(b.encode("utf-8", "surrogatepass"), 1) for b in bare), np.uint64, n)
    five = np.fromiter((fives[b[:5]] for b in bare), np.uint64, n)
    four = np.fromiter((fours[b[:4]] for b in bare), np.uint64, n)
    rest = np.uint64((1 << OWN_BITS) - 1)
    top = four & ~rest
    return np.stack([top | whole & rest, top | five & rest, four], axis=1)


def feature_hashes(word: str) -> tuple[int, int, int]:
    return tuple(features_of([word])[0].tolist())


class Numbers(dict):
    """word -> number in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def copy_mark(text: str | None) -> int:
    """Smallest hash of the word triples of a text, alike for near copies."""
    words = (text or "").lower().split()
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if len(h) < 3:
        return xxhash.xxh64_intdigest(h.tobytes()) >> 1
    mixed = (h[:-2] * np.uint64(3) ^ h[1:-1]) * np.uint64(5) ^ h[2:]
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    return int((mixed ^ mixed >> np.uint64(32)).min()) >> 1


@F.arrow_udf(T.LongType())
def copy_marks(texts: pa.Array) -> pa.Array:
    return pa.array([copy_mark(t) for t in texts_of(texts)], pa.int64())


def labelled_texts(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic, part, kind, vote) of the learnable labelled rows, written once: the
    only rows whose labels are met. Of more than `most` ids, those of the lowest hashes."""
    usable = labels.where(learnable() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = staged(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_label_id"), "chosen-labels")
    some = bounded_batches(documents).where(learnable()).select("doc_id", "text")
    met = some.join(F.broadcast(chosen), some["doc_id"] == chosen["_label_id"])  # at most `most` rows
    marked = staged(met.select("doc_id", "text", "toxic", fold().cast("int").alias("part"), copy_marks("text").alias("mark")), "labelled-texts")
    shared = marked.groupBy("mark", "toxic").agg((1 / F.count(F.lit(1))).alias("vote"))
    kind = (F.col("part") * 2 + F.when(F.col("toxic") == 1, 1).otherwise(2)).cast("int")
    return marked.join(shared, ["mark", "toxic"]).select("doc_id", "text", "toxic", "part", kind.alias("kind"), "vote")


def votes(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, toxic, vote) of the learnable labelled rows."""
    return labelled_texts(documents, labels, most).select("doc_id", "toxic", "vote")


def feature_counts(documents: DataFrame, labels: DataFrame, known_texts: DataFrame | None = None) -> DataFrame:
    """(feature, c0 .. c4): documents by the features they hold, a column for each of CLASSES, of
    the features known from ENOUGH labelled documents; and, as feature null, the sums over all
    features. The corpus is counted where it is read, for known features only."""
    if known_texts is None:
        known_texts = staged(labelled_texts(documents, labels, LABELLED), "voting-texts")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("votes")).otherwise(0.0)).alias(f"c{k}") for k in range(CLASSES)]
    mine = staged(counted_features(known_texts.select("text", "kind", "vote")).groupBy("feature").agg(*sums), "labelled-counts")
    enough = mine.where(sum((F.col(f"c{k}") for k in range(2, CLASSES)), F.col("c1")) >= ENOUGH)
    features = np.sort(enough.select("feature").toArrow().column("feature").to_numpy())
    sent = documents.sparkSession.sparkContext.broadcast(features)
    corpus = counted_features(documents.select("text", F.lit(0).alias("kind"), F.lit(1.0).alias("vote")), sent)
    whole = mine.select(F.lit(None).cast("long").alias("feature"), *[f"c{k}" for k in range(CLASSES)])
    rows = enough.union(whole).union(corpus.groupBy("feature").agg(*sums))
    return rows.groupBy("feature").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(CLASSES)])


def counted_features(rows: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """(feature, kind, votes): sums of vote over the texts of a task that hold a feature, for each
    kind; a feature may have several rows. rows: (text, kind, vote). With `wanted`, features in
    order, the others only enter the sum of all, which has feature null."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_kept("counts", dict)
        numbers = Numbers()
        counts = [np.zeros(0)] * CLASSES

        def settled() -> Iterator[pa.RecordBatch]:
            hashes = features_of(numbers).view(np.int64)
            for k in range(CLASSES):
                some = np.flatnonzero(counts[k])
                if len(some):
                    features, shared = hashes[some].ravel(), np.repeat(counts[k][some], 3)
                    if wanted is not None:
                        total, known = shared.sum(), wanted.value
                        at = np.searchsorted(known, features)
                        held = np.flatnonzero(np.append(known, 0)[at] == features)
                        held = held[at[held] < len(known)]
                        sums = np.bincount(at[held], shared[held], len(known)).astype(float)
                        held = np.flatnonzero(sums)
                        features, sums = known[held], sums[held]
                        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([k], pa.int32()), pa.array([total])], ["feature", "kind", "votes"])
                    else:
                        features, back = np.unique(features, return_inverse=True)
                        sums = np.bincount(back, shared)
                    yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(np.full(len(features), k, np.int32)), pa.array(sums)], ["feature", "kind", "votes"])
            numbers.clear()

        for batch in sliced(batches):
            seen: list[list[np.ndarray]] = [[] for _ in range(CLASSES)]
            shares: list[list[float]] = [[] for _ in range(CLASSES)]
            for text, kind, vote in zip(*(batch.column(c).to_pylist() for c in ("text", "kind", "vote"))):
                if text:
                    words = set(text.lower().split())
                    seen[kind].append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    shares[kind].append(vote)
            for k in range(CLASSES):
                if len(counts[k]) < len(numbers):
                    counts[k] = np.pad(counts[k], (0, len(numbers) - len(counts[k])))
                if seen[k]:
                    votes_of = np.repeat(np.array(shares[k]), [len(ids) for ids in seen[k]])
                    counts[k] += np.bincount(np.concatenate(seen[k]), votes_of, len(counts[k]))
            if len(numbers) > FLUSH:
                yield from settled()
                counts = [np.zeros(0)] * CLASSES
        if numbers:
            yield from settled()

    return rows.mapInArrow(counted, "feature long, kind int, votes double")


def feature_weights(counts: DataFrame) -> DataFrame:
    """(feature, w0, w1, w2) of the features that can change a word's score: cautious log-odds by
    LEARNED, null where too little is known."""
    counts = staged(counts, "feature-counts")
    totals = [x or 0.0 for x in (counts.where("feature IS NULL").select(*[f"c{k}" for k in range(CLASSES)]).first() or [0.0] * CLASSES)]
    counts = counts.where("feature IS NOT NULL")
    weights = []
    for toxic_at, other_at in LEARNED:
        toxic_all, other_all = sum(totals[k] for k in toxic_at), sum(totals[k] for k in other_at)
        strength = PRIOR * (toxic_all + other_all)
        whole = FLAT * POSSIBLE + strength
        toxic, other = (sum((F.col(f"c{k}") for k in at[1:]), F.col(f"c{at[0]}")) for at in (toxic_at, other_at))
        prior = FLAT + F.col("c0") * (strength / max(1.0, totals[0]))
        a, b = toxic + prior, other + prior
        ratio = F.log(a / (toxic_all + whole - a)) - F.log(b / (other_all + whole - b))
        weights.append(F.when(toxic + other >= ENOUGH, ratio - CAUTION * F.sqrt(1 / a + 1 / b)).alias(f"w{len(weights)}"))
    known = staged(counts.select("feature", *weights).where("w0 IS NOT NULL"), "known-features")
    above = F.greatest("w0", "w1", "w2") > FLOOR
    start = F.shiftrightunsigned("feature", OWN_BITS)
    hiding = known.where(~above).withColumn("_start", start).join(known.where(above).select(start.alias("_start")), "_start", "left_semi")
    return known.where(above).union(hiding.drop("_start"))


def collected(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features in order and their three weights, NaN for null."""
    table = weights.toArrow()
    features = table.column("feature").to_numpy()
    order = np.argsort(features)
    columns = [table.column(c).cast(pa.float32()).to_numpy() for c in ("w0", "w1", "w2")]
    return features[order], np.stack([c[order] for c in columns])


class WordScores(dict):
    """word -> number; `scores[k][number]` is its score by the k-th weights. Words met since the
    last `settle` have no score yet."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.features, self.weights = features, weights
        self.scores = [array("f") for _ in weights]
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def settle(self) -> None:
        """Scores of the fresh words: the weight of the most special known feature."""
        hashes = features_of(self.fresh).view(np.int64)
        at = np.minimum(np.searchsorted(self.features, hashes), max(0, len(self.features) - 1))
        hit = self.features[at] == hashes if len(self.features) else np.zeros(hashes.shape, bool)
        for weights, scores in zip(self.weights, self.scores):
            found = np.where(hit, weights[at], np.nan) if len(self.features) else np.full(hashes.shape, np.nan)
            usable = ~np.isnan(found)
            best = found[np.arange(len(found)), usable.argmax(1)]
            scores.frombytes((np.where(usable.any(1), np.clip(best, FLOOR, CEILING), FLOOR) - DRIFT).astype(np.float32).tobytes())
        self.fresh = []

    def of(self, words: list[str], *kinds: int) -> list[np.ndarray]:
        """Scores of the words of a text, wherever they stand, by some of the weights."""
        return [self.of_texts([words], [k])[0] for k in kinds]

    def of_texts(self, texts: list[list[str]], kinds: list[int]) -> list[np.ndarray]:
        """Scores of the words of each text by the weights chosen for it; the fresh words of all
        texts are looked up together."""
        if len(self) > REMEMBERED:
            self.clear()
            self.scores = [array("f") for _ in self.weights]
        ids = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.fresh:
            self.settle()
        return [np.frombuffer(self.scores[k], np.float32)[i].astype(np.float64) if len(i) else np.zeros(0) for i, k in zip(ids, kinds)]


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All disjoint maximal-scoring segments (score, start, end) of a sequence, in one pass: each
    positive score opens a segment, which swallows those on its left that it improves."""
    total = np.cumsum(scores, dtype=np.float64)
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum at its end, start, end, the last one before that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, start = (float(total[i - 1]) if i else 0.0), float(total[i]), i
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= low:
                at = found[at][4]
            if at < 0 or found[at][1] >= high:
                break
            low, start = found[at][0], found[at][2]
            del found[at:]
            at = len(found) - 1
        found.append((low, high, start, i + 1, at))
    return [(high - low, start, end) for low, high, start, end, _ in found]


@dataclass
class ToxicityModel:
    known: Broadcast
    rate: float  # lambda of the extreme-value law
    scale: float  # K
    slope: float
    offset: float

    def weights(self) -> WordScores:
        return scores_of(self.known)

    def evidence(self, n: int, segments: list[tuple[float, int, int]]) -> float:
        """Sum over the significant segments of how far each lies beyond chance."""
        return evidence_of(n, [s for s, _, _ in segments], self.rate, self.scale)

    def passages(self, text: str) -> list[tuple[float, int, int]]:
        """Significant passages of a text: (score, first word, word after the last)."""
        words = text.lower().split()
        bound = significant_score(len(words), self.rate, self.scale)
        return [s for s in maximal_segments(self.weights().of(words, 0)[0]) if s[0] >= bound]


def scores_of(known: Broadcast) -> WordScores:
    """The word scores a Python worker keeps for one broadcast."""
    name, features, weights = known.value
    return worker_kept(name, lambda: WordScores(features, weights))


def significant_score(n: int, rate: float, scale: float) -> float:
    """Least score of a segment in n words that chance reaches in fewer than SIGNIFICANT texts."""
    return math.log(max(1e-300, scale * max(1, n) / -math.log1p(-SIGNIFICANT))) / rate


def evidence_of(n: int, scores: list[float], rate: float, scale: float) -> float:
    bound = significant_score(n, rate, scale)
    return sum(rate * (s - bound) + 1.0 for s in scores if s >= bound)


def cross_segments(known_texts: DataFrame, words_known: Broadcast) -> DataFrame:
    """(toxic, n, scores): words and scores of all maximal segments of each labelled text, by the
    weights of the other fold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = scores_of(words_known)
        for batch in sliced(batches, TOGETHER):
            words = [(text or "").lower().split() for text in batch.column("text").to_pylist()]
            sizes = list(map(len, words))
            found = weights.of_texts(words, [1 + part for part in batch.column("part").to_pylist()])
            scores = [[s for s, _, _ in maximal_segments(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    kind = known_texts.schema["toxic"].dataType.simpleString()
    return known_texts.select("toxic", "text", "part").mapInArrow(scan, f"toxic {kind}, n long, scores array<double>")


def fit_extremes(clean: DataFrame) -> tuple[float, float]:
    """lambda and K from the best segments of ordinary texts, by maximum likelihood on sums binned
    by best score (steps of 0.05; scores are bounded by CEILING a word, larger ones share a bin)."""
    best = F.least(F.coalesce(F.array_max("scores"), F.lit(0.0)), F.lit(200.0))
    rows = clean.where("n > 0").groupBy(F.round(best * 20).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
    if not rows:
        return 1.0, 0.1
    x, k, n = (np.array(c, float) for c in zip(*((r["bin"] / 20, r["k"], r["n"]) for r in rows)))
    low, high = 0.05, 20.0
    for _ in range(60):  # the likelihood's slope falls in lambda
        rate = (low + high) / 2
        w = n * np.exp(-rate * (x - x.min()))
        slope = k.sum() / rate - (k * x).sum() + k.sum() * (w * x).sum() / w.sum()
        low, high = (rate, high) if slope > 0 else (low, rate)
    return rate, float(k.sum() / (n * np.exp(-rate * x)).sum())


def evidence_column(rate: float, scale: float) -> Column:
    """evidence_of as a column over n and scores."""
    bound = F.log(F.greatest(F.lit(1e-300), F.lit(scale / -math.log1p(-SIGNIFICANT)) * F.greatest(F.col("n"), F.lit(1)))) / rate
    return F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.when(s >= bound, (s - bound) * rate + 1.0).otherwise(0.0))


def squashed(evidence: Column) -> Column:
    """Evidence on a bounded scale (0 to about 14) for the last step."""
    return F.log1p(F.least(evidence, F.lit(1e6)))


def fit_probability(rows: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic step over squashed evidence, from counts binned by it;
    targets are drawn in by the usual (n + 1) / (n + 2)."""
    bins = rows.groupBy(F.round(squashed(F.col("evidence")) * 50).alias("bin")).agg(
        F.sum(F.col("toxic").cast("long")).alias("t"), F.count(F.lit(1)).alias("k")).collect()
    x, t, k = (np.array(c, float) for c in zip(*((r["bin"] / 50, r["t"], r["k"]) for r in bins))) if bins else (np.zeros(0),) * 3
    if not t.sum() or t.sum() == k.sum():
        return 0.0, -50.0
    up, down = (t.sum() + 1) / (t.sum() + 2), 1 / (k.sum() - t.sum() + 2)
    goal = t * up + (k - t) * down
    params = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(params[0] * x + params[1])))
        g = np.array([((k * p - goal) * x).sum() + 1e-3 * params[0], (k * p - goal).sum()])
        h = k * p * (1 - p) + 1e-9
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hessian, g)
        params -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(0.0, params[0])), float(params[1])


def fit(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[ToxicityModel, DataFrame]:
    """The model of at most `most` labelled ids, and (toxic, n, scores) of their texts."""
    known_texts = staged(labelled_texts(documents, labels, most), "voting-texts")
    weights = collected(feature_weights(feature_counts(documents, labels, known_texts)))
    words_known = documents.sparkSession.sparkContext.broadcast((f"toxic words {uuid.uuid4()}", *weights))
    known = staged(cross_segments(known_texts, words_known), "known-segments")
    rate, scale = fit_extremes(known.where("toxic = 0"))
    slope, offset = fit_probability(known.withColumn("evidence", evidence_column(rate, scale)))
    return ToxicityModel(words_known, rate, scale, slope, offset), known


def probability(model: ToxicityModel) -> Column:
    """Probability of `text` being toxic: each text is scanned once."""

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        weights, out = model.weights(), []
        for start in range(0, len(texts), TOGETHER):
            words = [(text or "").lower().split() for text in texts.slice(start, TOGETHER).to_pylist()]
            out += [model.evidence(len(f), maximal_segments(f)) for f in weights.of_texts(words, [0] * len(words))]
        return pa.array(out, pa.float64())

    return 1 / (1 + F.exp(-(squashed(evidence("text")) * model.slope + model.offset)))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model, _ = fit(documents, labels)
    out = bounded_batches(documents).select("doc_id", (~learnable()).alias("held_out"), probability(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those predicted toxic; each row is judged by its own text."""
    return bounded_batches(documents).where(probability(fit(documents, labels)[0]) < REJECT)
