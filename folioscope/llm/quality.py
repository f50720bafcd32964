"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once for each document and keeps the measurements and one bit for
each failed rule. A policy is a named, versioned mask of rules; `decide` applies one to a ledger
and `ablation` compares policies by bitwise aggregation, without reading a text again.

Cases: a null text has no words; measurements of empty texts are 0 and ratios are compared by
cross multiplication, so nothing divides by zero; equal rows give equal rows; an empty table
gives no row and an ablation of zeros; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_batches, sliced

SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\f\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next", "n_shouts"]

#: rule -> (bit, fails if). Ratios are cross-multiplied integers.
RULES = {
    "few_words": (1, "n_words < 50"),
    "repeated_windows": (2, "100 * n_repeat_words > 50 * n_words"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (8, "word_chars > 15 * n_words"),
    "symbols": (16, "100 * n_symbols > 25 * n_words"),
    "duplicate_lines": (32, "100 * n_dup_lines > 50 * n_lines"),
    "same_word_next": (64, "100 * n_same_next > 25 * n_words"),
    "shouting": (128, "100 * n_shouts > 40 * n_words"),
}
#: Versioned policies: which rules reject. `base` alone is what every policy shares.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "same_word_next", "shouting"],
    "v2": list(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(RULES[r][0] for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text. Words are what bytes.split() cuts: the six ASCII blanks only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANK_BYTES)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeated = 0
    if n > 2:
        base = len(numbers)
        pairs = ids[:-1] * base + ids[1:]
        if base >= 1 << 20:  # so that the triple fits 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        repeated = int(covered.sum())
    shouts = sum(times for times, w in zip(np.bincount(ids, minlength=len(numbers)).tolist(), numbers) if w.isupper() and len(w) > 1)
    return (n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), int((ids[1:] == ids[:-1]).sum()), shouts)


def ledger(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits of every document."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])

    doc_type = documents.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(documents).select("doc_id", "text").mapInArrow(measured, f"doc_id {doc_type}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(fails), bit).otherwise(0) for bit, fails in RULES.values()), F.lit(0))
    return rows.withColumn("failed_bits", bits.cast("int"))


def rejected(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) != 0


def decide(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy."""
    return entries.withColumn("base_failed", rejected(F.col("failed_bits"), "base")).withColumn("kept", ~rejected(F.col("failed_bits"), policy))


def ablation(entries: DataFrame) -> DataFrame:
    """A row for each policy and rule of it: documents kept by the policy, documents that fail
    the rule, and documents that only this rule of the policy rejects (what leaving it out wins)."""
    counts = []
    for policy, rules in POLICIES.items():
        whole = F.lit(mask(policy))
        for rule in rules:
            bit = RULES[rule][0]
            hit = F.col("failed_bits").bitwiseAND(whole)
            counts.append(F.struct(
                F.lit(policy).alias("policy"), F.lit(rule).alias("rule"), F.count(F.when(hit == 0, 1)).alias("kept"),
                F.count(F.when(hit.bitwiseAND(F.lit(bit)) != 0, 1)).alias("failed"), F.count(F.when(hit == bit, 1)).alias("only_this")))
    return entries.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))
