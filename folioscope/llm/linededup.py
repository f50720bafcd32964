"""Line dedup with levelled sorted runs of line hashes.

`LineRuns` keeps, for every line key seen so far, its 128-bit hash and the first document that
holds it, in sorted runs. A new batch is merge-anti-joined with the runs, and what it adds
becomes a run of the lowest level; when a level is full its runs are merged into one run of the
next. `deduplicated` feeds the documents in batches of ascending doc_id, so that the holder kept
in the runs is the smallest doc_id.

Cases: a null or empty text is one empty line; keys under `min_chars` code points never go; rows
with one doc_id count as one document, and each keeps or loses its own lines; a null doc_id
sorts last (its lines go if any other document holds them, and null rows count as one document);
an empty table gives no row; other columns pass through `deduplicated` unless named like an
output column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import BLANKS
from folioscope.session import drop_path, scratch_path, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark() -> Column:
    """With the doc_id it names a row's text, so that places of lines belong to it."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_hashes(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, at, h, g): place and hashes of every line whose key is long enough."""
    keys = F.transform(text_lines(F.col("text")), lambda line, i: F.struct(i.alias("at"), line_key(line).alias("key")))
    long_ones = F.filter(keys, lambda k: F.length(k["key"]) >= min_chars)
    found = F.transform(long_ones, lambda k: F.struct(k["at"].alias("at"), key_hash(k["key"]).alias("k")))
    # Marked before the lines become rows: beside them the whole text would be hashed for each line.
    marked = documents.select("doc_id", text_mark().alias("mark"), found.alias("found"))
    return marked.select("doc_id", "mark", F.explode("found").alias("x")).select("doc_id", "mark", "x.at", "x.k.h", "x.k.g")


class LineRuns:
    """Levelled runs in a folder of their own below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.folder = scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.written = 0
        self.schema = None

    def read(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}-run-{self.written}"
        self.written += 1
        rows = rows.select("h", "g", "holder")
        self.schema = rows.schema
        rows.sortWithinPartitions("h", "g").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                merged = self.spark.read.schema(self.schema).parquet(*old)
                self._write(merged.repartition("h", "g"), level + 1)
                self.levels[level] = []
                for path in old:
                    drop_path(self.spark, path)
            level += 1

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, h, g). Its new hashes become a run; hashes already in a run keep
        their earlier holder."""
        first = batch.groupBy("h", "g").agg(F.min("doc_id").alias("holder"))
        seen = self.read()
        if seen is not None:
            first = first.join(seen.select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        self._write(first, 0)
        self._compact()


def lost_lines(hashes: DataFrame, runs: LineRuns) -> DataFrame:
    """(doc_id, mark, lost): places, in order, of the lines a text loses to an earlier holder."""
    held = runs.read()
    pairs = hashes.join(held, ["h", "g"]).where(
        F.col("holder").isNotNull() & (F.col("doc_id").isNull() | (F.col("holder") < F.col("doc_id"))))
    return pairs.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("at")).alias("lost"))


def batch_edges(hashes: DataFrame, batches: int) -> list:
    """doc_ids that cut the lines into about equal batches; they only decide where work runs."""
    marks = [i / batches for i in range(1, batches)]
    if isinstance(hashes.schema["doc_id"].dataType, T.NumericType):
        return sorted(set(hashes.agg(F.percentile_approx("doc_id", marks, 10_000)).first()[0] or []))
    some = sorted(r[0] for r in hashes.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id")).limit(1000).collect())
    return sorted({some[int(m * len(some))] for m in marks}) if some else []


def deduplicated(documents: DataFrame, min_chars: int = 10, batches: int = 4) -> DataFrame:
    """documents with `text` reduced to the lines that stay, n_lines (before) and n_dropped."""
    spark = documents.sparkSession
    hashes = staged(line_hashes(documents, min_chars), "line-hashes")
    edges = [None, *batch_edges(hashes, batches), None]
    runs = LineRuns(spark)
    for low, high in zip(edges, edges[1:]):
        batch = hashes
        if low is not None:
            batch = batch.where((F.col("doc_id") >= low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") >= low)
        if high is not None:
            batch = batch.where(F.col("doc_id") < high)
        runs.add(batch)
    # Written once: its places are looked up for each line.
    lost = staged(lost_lines(hashes, runs), "lost-lines").select(F.col("doc_id").alias("_lost_id"), F.col("mark").alias("_lost_mark"), F.col("lost").alias("_lost"))
    others = [c for c in documents.columns if c not in ("text", "n_lines", "n_dropped")]
    # Split before the join, so that no later expression splits the text for each of its lines.
    marked = documents.select(*others, text_mark().alias("_mark"), text_lines(F.col("text")).alias("_lines"))
    joined = marked.join(lost, marked["doc_id"].eqNullSafe(F.col("_lost_id")) & (F.col("_mark") == F.col("_lost_mark")), "left")

    def stretch(stop: Column, i: Column) -> Column:
        """True for the lines that stay before a lost one, or before the end, false for that."""
        first = F.when(i > 0, F.get("_lost", i - 1) + 1).otherwise(0)
        return F.concat(F.array_repeat(F.lit(True), stop - first), F.array(F.lit(False)))

    stays = F.flatten(F.transform(F.concat("_lost", F.array(F.size("_lines"))), stretch))
    paired = F.filter(F.arrays_zip(F.col("_lines").alias("line"), stays.alias("stays")), lambda x: x["stays"])
    kept = F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(paired, lambda x: x["line"]))
    out = joined.select(*others, kept.alias("_kept"), F.size("_lines").cast("long").alias("n_lines"))
    return out.select(
        *others, F.array_join("_kept", "\n").alias("text"), "n_lines",
        (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
