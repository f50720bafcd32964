"""Token counts by heap-and-linked-list byte-pair merging.

Counts what a byte-fallback BPE piece model gives, without making identifiers: the characters of
a unit are linked symbols; the adjacent pair that forms the best-ranked piece (the leftmost of
equal ones) is popped from a heap and merged until no pair forms a piece. The count is initial
symbols minus merges, where a symbol that is no piece stands for its UTF-8 bytes.

Blanks become the space mark and one more is put in front. `MergeCounter` checks that no piece
has a character before a space mark, so a text falls into units "marks + other characters" that
never merge with each other; inside a unit, two neighbouring characters that stand together in
no piece are a border no merge can cross. Counts of units and of the parts between such borders
are remembered by the Python worker, `REMEMBERED` of each at most; beyond that they are counted
anew, which costs time only.

Cases: null and empty texts have 0 tokens and bytes; control strings inside texts are ordinary
text; texts are taken whole whatever their length; equal rows give equal rows; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folioscope.llm.common import bounded_batches, sliced, worker_kept

MARK = "▁"
REMEMBERED = 400_000
UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class MergeCounter(dict):
    """unit -> tokens, counted on first use."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.piece_size()
        self.ranks = {
            model.id_to_piece(i): -model.get_score(i) for i in range(n)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.ranks):
            raise ValueError("a piece holds a space mark after another character; texts can't be cut at marks")
        self.joined = {p[i:i + 2] for p in self.ranks for i in range(len(p) - 1)}
        self.parts: dict[str, int] = {}

    def __missing__(self, rest: str) -> int:
        """rest: a unit without its first mark."""
        unit, joined, parts = MARK + rest, self.joined, self.parts
        n = start = 0
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1:i + 1] not in joined:
                part = unit[start:i]
                start = i
                tokens = parts.get(part)
                if tokens is None:
                    tokens = self.merged(part)
                    if len(parts) < REMEMBERED:
                        parts[part] = tokens
                n += tokens
        if len(self) < REMEMBERED:
            self[rest] = n
        return n

    def merged(self, part: str) -> int:
        """Tokens of a part, by merging."""
        ranks = self.ranks
        symbols = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        heap = [(ranks[pair], i, len(pair)) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in ranks]
        heapify(heap)
        merges = 0
        while heap:
            _, left, size = heappop(heap)
            right = after[left] if symbols[left] else -1
            if right < 0 or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            merges += 1
            far = after[left] = after[right]
            if far >= 0:
                before[far] = left
                if (pair := symbols[left] + symbols[far]) in ranks:
                    heappush(heap, (ranks[pair], left, len(pair)))
            near = before[left]
            if near >= 0 and (pair := symbols[near] + symbols[left]) in ranks:
                heappush(heap, (ranks[pair], near, len(pair)))
        extra = sum(len(s.encode()) - 1 for s in symbols if s and s not in ranks)
        return n - merges + extra

    def text(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return sum(map(self.__getitem__, parts))
        marked = MARK + text.replace(" ", MARK)
        return sum(self[u[1:]] for u in UNIT.findall(marked))


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. model_path: a piece model that
    executors find under the same path."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_kept(("pieces", model_path), lambda: MergeCounter(model_path))
        for batch in sliced(batches):
            texts = batch.column("text")
            tokens = pa.array([counter.text(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    doc_type = documents.schema["doc_id"].dataType.simpleString()
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(count, f"doc_id {doc_type}, n_bytes long, n_tokens long, over_limit boolean")
