"""Token ids as wavelet matrices, one for each shard.

Documents are range-sorted by doc_id; each task encodes its range, appends the end id to every
document and cuts the stream at document borders into shards of about `SHARD_TOKENS` ids. A
shard is one row of a Parquet file: the document table and, for each bit from the highest, the
packed bit plane, the number of zeros and the ones before every block of 512 bits. That is 2
bytes a token (6 % more for rank), compressed once more by the file format, and it answers token
access, rank, count and select without unpacking the rest. The files are written by Spark's
committer, so a lost executor leaves no half-written shard.

Cases: null and empty texts hold the end id only; a document longer than a shard is a shard of
its own; equal doc_ids stand by a hash of the text, null ids last; an empty table gives no shard and no row;
other columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import bounded_batches, sliced, worker_kept
from folioscope.session import scratch_path

END_ID = 0
SHARD_TOKENS = 1 << 21
BLOCK = 512
REMEMBERED, MARKED, MET = 300_000, 100_000, 1 << 22
PIECE = 1 << 16
MARKS = string.punctuation


def _byte_characters() -> dict[int, str]:
    """The characters a byte-level vocabulary is written in: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder(dict):
    """Whole texts to ids with a byte-level BPE file of the tokenizers library.

    Its pattern always cuts before a single blank that stands in front of another character, so
    texts are taken apart there: at every blank, unless some blank stands in front of white space
    or the end (`LOOSE`). In such a part, letters alone are one word of the pattern and go
    straight to the library's model; a part of lines of letters with marks behind them falls
    into its words; all other parts, and texts with an added token,
    take the library's whole way. As a dictionary it holds the ids of parts by what follows their
    blank, `parts` holds those of other parts; the Python worker keeps `REMEMBERED` of each.
    Words are kept when met again (`met` marks them by hash), as most are rare. Those with marks are
    put together from both, so only `MARKED` of them are kept beside the words."""

    CUT = re.compile(r"(?= \S)")
    LOOSE = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = _byte_characters()
        self.codes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {}
        self.marked, self.met = 0, bytearray(MET)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, bare: str) -> bytes:
        letters = bare.isalpha()
        if letters:
            ids = self.word(" " + bare)
        else:
            body = bare.rstrip(MARKS)
            ids = self[body] + self.part(bare[len(body):]) if body.isalpha() else self.fresh(" " + bare)
        at = hash(bare) % MET
        if not self.met[at]:
            self.met[at] = 1
        elif letters and len(self) - self.marked < REMEMBERED:
            self[bare] = ids
        elif not letters and self.marked < MARKED:
            self.marked += 1
            self[bare] = ids
        return ids

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.fresh(part)
            if len(self.parts) < REMEMBERED:
                self.parts[part] = ids
        return ids

    def fresh(self, part: str) -> bytes:
        if not part:
            return b""
        bare = part[1:] if part[:1] == " " else part
        ids = self.word(part) if bare.isalpha() or len(part) == 1 else self.words_of(part)
        return self.whole(part) if ids is None else ids

    def word(self, word: str) -> bytes:
        """One word of the pattern."""
        text = word.replace(" ", self.bytes[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)
        return b"".join([self.codes[t.id] for t in self.model.tokenize(text)])

    def words_of(self, part: str) -> bytes | None:
        """A part made of lines of letters and marks behind them, with single line ends between."""
        found = []
        for i, line in enumerate(part.split("\n")):
            body = line.rstrip(MARKS)
            letters = body[1:] if not i and body[:1] == " " else body
            if not letters.isalpha():
                return None
            if i:
                found.append(self.part("\n"))
            found.append(self[letters] if letters is not body else self.part(body))
            if len(body) < len(line):
                found.append(self.part(line[len(body):]))
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.LOOSE.search(text):
            return b"".join(map(self.part, self.CUT.split(text)))
        head, *rest = text.split(" ")
        return self.part(head) + b"".join(map(self.__getitem__, rest))


def _parted(ones: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Places of the zeros and of the ones of each piece. By places and in pieces that a core's
    cache holds: masks take twice the time where bits are mixed."""
    for start in range(0, len(ones), PIECE):
        piece = ones[start:start + PIECE]
        yield slice(start, start + len(piece)), np.flatnonzero(~piece), np.flatnonzero(piece)


class WaveletMatrix:
    """Bit planes over a sequence of ids below 2 ** len(planes)."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.planes, self.zeros = n, [np.frombuffer(p, np.uint8) for p in planes], zeros
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray) -> tuple[list[bytes], list[int], list[bytes]]:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in range(width - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones)
            blocks = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))).view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            planes.append(packed.tobytes())
            zeros.append(int(len(ones) - blocks.sum()))
            ranks.append(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes())
            if bit:
                low, high, after = 0, zeros[-1], np.empty_like(now)
                for at, down, up in _parted(ones):
                    after[low:low + len(down)], after[high:high + len(up)] = now[at].take(down), now[at].take(up)
                    low, high = low + len(down), high + len(up)
                now = after
        return planes, zeros, ranks

    def _bits(self, plane: int, start: int, stop: int) -> np.ndarray:
        return np.unpackbits(self.planes[plane][start // 8:(stop + 7) // 8])[start % 8:start % 8 + stop - start]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        return int(self.ranks[plane][block]) + int(self._bits(plane, block * BLOCK, i).sum())

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit = int(self._bits(k, i, i + 1)[0])
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self._ones(k, start), self._ones(k, stop)
            start, stop = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (len(self.planes) - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a symbol in [start, stop)."""
        if symbol >> len(self.planes):
            return 0
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def _select_bit(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that value in a plane."""
        ones = self.ranks[plane].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, j, "right")) - 1
        at = np.flatnonzero(self._bits(plane, block * BLOCK, min(self.n, (block + 1) * BLOCK)) == bit)
        return block * BLOCK + int(at[j - before[block]])

    def select(self, symbol: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of a symbol."""
        if not 0 <= j < self.count(symbol):
            raise IndexError(j)
        i = self._range(symbol, 0, self.n)[0] + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """The whole sequence, planes undone from the last."""
        low = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = self._bits(k, 0, self.n).view(bool)
            bit = low.dtype.type(1 << (len(self.planes) - 1 - k))
            a, b, before = 0, self.zeros[k], np.empty_like(low)
            for at, down, up in _parted(ones):
                piece = before[at]
                piece[down], piece[up] = low[a:a + len(down)], low[b:b + len(up)] | bit
                a, b = a + len(down), b + len(up)
            low = before
        return low


def _shard_schema(doc_type: str) -> str:
    return (f"part int, shard int, n_tokens long, doc_ids array<{doc_type}>, doc_lengths array<long>, "
            "planes array<binary>, zeros array<long>, ranks array<binary>")


def write_shards(documents: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes documents in ascending doc_id and writes their shards below path."""
    doc_field = documents.schema["doc_id"].dataType
    doc_arrow = pa.int64() if isinstance(doc_field, T.LongType) else None

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = worker_kept(("ids", tokenizer), lambda: WordEncoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        held, ids, lengths, size, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            planes, zeros, ranks = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"))
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()),
                   pa.array([ids], pa.list_(doc_arrow) if doc_arrow else None), pa.array([lengths], pa.list_(pa.int64())),
                   pa.array([planes], pa.list_(pa.binary())), pa.array([zeros], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "n_tokens", "doc_ids", "doc_lengths", "planes", "zeros", "ranks"])

        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                code = encoder.encode(text) + end
                n = len(code) // 4
                if held and size + n > shard_tokens:
                    yield flush()
                    held, ids, lengths, size, number = [], [], [], 0, number + 1
                held.append(code)
                ids.append(doc)
                lengths.append(n)
                size += n
        if held:
            yield flush()

    keys = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("text").asc_nulls_first()]
    ranged = bounded_batches(documents).select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)
    ranged.mapInArrow(shards, _shard_schema(doc_field.simpleString())).write.option("parquet.block.size", 64 << 20).option("compression", "zstd").parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the
    shards' planes. Starts come from the shards' sizes: a running sum over the parts' totals and
    one inside each part."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "shard", (F.col("base") + F.col("inside")).alias("shard_start"))
    doc_type = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, shard, n, lengths, planes, zeros, ranks = (batch.column(c)[i].as_py() for c in ("part", "shard", "n_tokens", "doc_lengths", "planes", "zeros", "ranks"))
                docs = batch.column("doc_ids")[i].values
                ids = WaveletMatrix(n, planes, zeros, ranks).ids().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                k = len(lengths)
                columns = [pa.array([part] * k, pa.int32()), pa.array([shard] * k, pa.int32()), docs, pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(decoded, f"part int, shard int, doc_id {doc_type}, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the shards into a new folder below the shared one and reads them back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-shards")
    write_shards(documents, tokenizer, path)
    schema = T._parse_datatype_string(_shard_schema(documents.schema["doc_id"].dataType.simpleString()))
    return read_documents(spark.read.schema(schema).parquet(path))
