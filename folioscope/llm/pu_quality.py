"""Quality by positive-unlabelled learning.

Trusted positives are the labelled good rows that may be learned from; every document of the
corpus is unlabelled text, whatever its label. A linear score g over `NAMES` (shares of marks,
letters, blanks, repeats and lines of a text, each as a clipped z-score over all documents)
minimises the non-negative unbiased risk with the logistic loss l(z) = log(1 + exp(-z)):

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) + RIDGE / 2 |w|^2

While the second part is not negative the risk is convex, because l(g) - l(-g) = -g, and falls by
damped Newton steps. A step that would make that part negative is not taken; if all are, the
weights move along its gradient until it isn't. Sums over documents are made in tasks and by
`groupBy`; what reaches the driver are `TRIALS` gradients and Hessians over the features a round.

The class prior is estimated from the scores by the best bin: the least share of unlabelled over
share of positive documents above a threshold, both with a margin for chance, over `BINS`
thresholds. Scores and prior are fitted in turns, `TURNS` times, the first with `GUESS`.

Cases: null and empty texts have no marks and one score; rows with one doc_id share a label; an
id with several labels is trusted only if all say 1; null ids match no label; without a trusted
positive every score is 0.5; equal texts have equal scores; texts are read whole; an empty table
gives no row; other columns are ignored by `scored` and `fit`.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_batches, sliced
from folioscope.session import staged

MARKS = string.punctuation.encode()
SHAPES = ["upper", "digits", "beyond_ascii", "blanks", "word_length", "words", "distinct_words", "same_next", "top_word",
          "repeated_windows", "distinct_lines", "line_words", "closed_lines", "marked_ends", "capitals"]
NAMES = [f"mark_{chr(m)}" for m in MARKS] + SHAPES
RIDGE, LIMIT, TRIALS, ROUNDS, CLOSE = 1e-3, 5.0, (1.0, 0.4, 0.1), 25, 1e-5
BINS, TURNS, GUESS = 400, 2, 0.5
ACCEPT = 0.7
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BLANK = np.array([b in b" \t\n\x0b\f\r" for b in range(256)])
_MARKS = np.frombuffer(MARKS, np.uint8)


def features(text: str | None) -> np.ndarray:
    """NAMES of a text; shares are square roots, so that small ones count."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    blanks = int(counts[_BLANK].sum())
    solid = max(1, len(raw) - blanks)
    upper, letters = int(counts[_UPPER].sum()), int(counts[_UPPER].sum() + counts[_LOWER].sum())
    marks = np.sqrt(counts[_MARKS] / solid)
    if not n:
        return np.concatenate([marks, np.zeros(len(SHAPES))])
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0.0
    if n > 3:
        pairs = ids[:-1] * len(numbers) + ids[1:]
        repeated = 1 - len(np.unique(pairs)) / (n - 1)
    closed = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines)
    ends = sum(w[-1] < 128 and not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122) for w in numbers)
    capitals = sum(65 <= w[0] <= 90 for w in numbers)
    shapes = [
        math.sqrt(upper / max(1, letters)), math.sqrt(counts[_DIGIT].sum() / solid), math.sqrt(counts[128:].sum() / solid), math.sqrt(blanks / len(raw)),
        math.log(solid / n), math.log1p(n), math.sqrt(len(numbers) / n), math.sqrt((ids[1:] == ids[:-1]).sum() / n), math.sqrt(np.bincount(ids).max() / n),
        math.sqrt(repeated), math.sqrt(len(set(lines)) / len(lines)), math.log1p(n / len(lines)), math.sqrt(closed / len(lines)),
        math.sqrt(ends / len(numbers)), math.sqrt(capitals / len(numbers))]
    return np.concatenate([marks, shapes])


def learnable() -> Column:
    """Rows whose labels may be used."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2


def featured(documents: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every document, 32-bit floats in a binary."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [features(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, x binary")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the learnable rows all of whose labels say good."""
    usable = labels.where(learnable() & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.min("quality").alias("_low")).where("_low = 1").select(F.col("doc_id").alias("_good_id"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(NAMES)).astype(np.float64)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the offset
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -40, 40)))


def summed(rows: DataFrame, size: int, sums) -> np.ndarray:
    """Sum over all rows of sums(x, good), a vector of `size`: made in tasks, added by groupBy."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(matrix(batch.column("x")), batch.column("good").to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    parts = rows.select("x", "good").mapInArrow(partial, "at int, value double")
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def standardised(rows: DataFrame) -> tuple[QualityModel, float, float]:
    """An unfitted model with the means and deviations of all documents; counts of documents
    and trusted ones."""
    d = len(NAMES)
    s = summed(rows, 2 * d + 2, lambda x, good: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), good.sum()]]))
    n = max(1.0, s[-2])
    mean = s[:d] / n
    scale = np.sqrt(np.maximum(s[d:2 * d] / n - mean ** 2, 0))
    return QualityModel(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(d + 1), GUESS), s[-2], s[-1]


def risk_sums(model: QualityModel, trials: np.ndarray):
    """For each trial's weights: unlabelled loss, gradient and Hessian; losses and gradients of
    the trusted rows."""

    def sums(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        z = model.inputs(x)
        out = []
        for w in trials:
            g = z @ w
            p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            zp, pp, gp = z[good], p[good], g[good]
            out += [[np.logaddexp(0, g).sum()], z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).ravel(),
                    [np.logaddexp(0, -gp).sum(), np.logaddexp(0, gp).sum()], zp.T @ (pp - 1), zp.T @ pp]
        return np.concatenate(out)

    return sums


def minimised(rows: DataFrame, model: QualityModel, n: float, n_good: float) -> QualityModel:
    """The model with weights of least non-negative risk under its prior."""
    d, prior = len(NAMES) + 1, model.prior
    size = 3 + 3 * d + d * d
    ridge = np.full(d, RIDGE)
    ridge[-1] = 0.0
    trials, best, step = model.weights[None, :], None, None
    for _ in range(ROUNDS):
        sums = summed(rows, size * len(trials), risk_sums(model, trials)).reshape(len(trials), size)
        states = []
        for w, s in zip(trials, sums):
            loss_u, grad_u = s[0] / n, s[1:1 + d] / n
            hessian = s[1 + d:1 + d + d * d].reshape(d, d) / n + np.diag(ridge + 1e-9)
            loss_p, loss_n = s[1 + d + d * d:3 + d + d * d] / n_good
            grad_p, grad_n = s[3 + d + d * d:].reshape(2, d) / n_good
            left = loss_u - prior * loss_n
            risk = prior * loss_p + max(0.0, left) + (ridge * w * w).sum() / 2
            states.append((risk, left, w, prior * grad_p + grad_u - prior * grad_n + ridge * w, hessian, grad_u - prior * grad_n))
        usable = [x for x in states if x[1] >= 0]
        if usable:
            now = min(usable, key=lambda x: x[0])
            if best is not None and best[0] - now[0] < CLOSE:
                return QualityModel(model.mean, model.scale, now[2] if now[0] < best[0] else best[2], prior)
            best = now
            step = -np.linalg.solve(now[4], now[3])
            trials = now[2] + np.outer(TRIALS, step)
        elif best is not None:  # every step overshot the bound: shorter ones
            step = step * TRIALS[-1]
            if np.abs(step).max() < CLOSE:
                break
            trials = best[2] + np.outer(TRIALS, step)
        else:  # no weights inside the bound yet: up along the gradient of the bounded part
            _, left, w, _, _, up = max(states, key=lambda x: x[1])
            trials = w + np.outer(np.array(TRIALS) * -left * 4, up / max(1e-12, up @ up))
    return QualityModel(model.mean, model.scale, best[2] if best else trials[0], prior)


def estimated_prior(rows: DataFrame, model: QualityModel, n: float, n_good: float) -> float:
    """Least ratio of tails over thresholds on the model's probability, with a margin of chance."""

    def tails(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        at = np.minimum((model.probability(x) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[good], minlength=BINS)])

    counts = summed(rows, 2 * BINS, tails)
    above_u, above_p = (np.cumsum(c[::-1])[::-1] for c in counts.reshape(2, BINS))
    margin = math.sqrt(math.log(4 * BINS) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(n_good))
    usable = above_p > 0
    share_u, share_p = above_u[usable] / n, above_p[usable] / n_good
    best = int(np.argmin((share_u + margin) / share_p))
    return float(min(0.99, max(0.01, share_u[best] / share_p[best])))


def fitted(rows: DataFrame) -> QualityModel | None:
    """The model, or None without a trusted row. rows: (x, good), read once for each round."""
    model, n, n_good = standardised(rows)
    if not n_good:
        return None
    for _ in range(TURNS):
        model = minimised(rows, model, n, n_good)
        model = QualityModel(model.mean, model.scale, model.weights, estimated_prior(rows, model, n, n_good))
    return minimised(rows, model, n, n_good)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[QualityModel | None, DataFrame]:
    """The model and (doc_id, x, good) of every document, written once."""
    rows, good = featured(documents), trusted(labels)
    flagged = rows.join(good, rows["doc_id"] == good["_good_id"], "left").select("doc_id", "x", F.col("_good_id").isNotNull().alias("good"))
    table = staged(flagged, "quality-features")
    return fitted(table), table


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model, table = fit(documents, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = table.select("doc_id", "x").mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
