"""Registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    chat, decontam, html_extract, k2search, linededup, mixing, periodic, pu_quality, quality, simhash, tokencount, toxicity, wavelet)
from folioscope.llm.common import table

CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.prefix_examples(turns.unionByName(more)))


def op2_style_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    return quality.decide(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_clusters(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "item_id", "matched", "item_words", "word_start", "word_end")


def op8_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.shares(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.withColumn("first_position", F.round(F.get("positions", F.lit(0)) + 1e-9, 6)).drop("positions")


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op12_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k2search.ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), periodic.tiled, texts=False)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (
    op1_chat_prefix_targets, op2_style_trees, op3_token_counts, op4_rule_ledger, op5_wavelet_shards,
    op6_segment_popcount, op7_spaced_seeds, op8_mix_curriculum, op9_line_runs, op10_toxic_segments,
    op11_pu_quality, op12_k2_treap_search, op13_periodic_runs)}

SQL = {
    "op1_chat_prefix_targets": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'), e AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(20 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?)(s>|INST\])', '\1\\\2\3', 'g'))
                + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?)(s>|INST\])', '\1\\\2\3', 'g')))
         OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op4_rule_ledger": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), w AS (
  SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)), t AS (
  SELECT rid, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)), f AS (
  SELECT rid, i, w, coalesce(w = w1, FALSE) AS same, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2) > 1 AS again FROM t), c AS (
  SELECT rid, length(w) AS chars, same, again OR coalesce(lag(again) OVER o, FALSE) OR coalesce(lag(again, 2) OVER o, FALSE) AS covered,
         regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') AND strlen(w) > 1 AS shout
  FROM f WINDOW o AS (PARTITION BY rid ORDER BY i)), a AS (
  SELECT rid, count(*) AS n_words, sum(chars) AS word_chars, count(*) FILTER (covered) AS n_repeat_words,
         count(*) FILTER (same) AS n_same, count(*) FILTER (shout) AS n_shouts FROM c GROUP BY rid), l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid), m AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_same, 0) AS n_same, coalesce(n_shouts, 0) AS n_shouts
  FROM d LEFT JOIN a USING (rid) LEFT JOIN l USING (rid)), b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
         + 8 * (word_chars > 15 * n_words)::INT + 16 * (100 * n_symbols > 25 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
         + 64 * (100 * n_same > 25 * n_words)::INT + 128 * (100 * n_shouts > 40 * n_words)::INT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits FROM b""",
    "op8_mix_curriculum": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')) AS k FROM documents), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), r AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(source_size) OVER () AS total FROM s), o AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS i FROM r), v AS (
  SELECT arg_min(level, i) AS level FROM o WHERE 3 * source_size >= level * weight), t AS (
  SELECT source, source_size, CASE weight WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE -0.5 END::DOUBLE AS slope,
         CASE WHEN 3 * source_size < v.level * weight THEN (3 * source_size)::DOUBLE ELSE v.level * weight END AS target
  FROM r, v), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + d.size::DOUBLE / 2 AS middle,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source), c AS (
  SELECT *, least(3, passes + CASE WHEN middle < target - passes * source_size THEN 1 ELSE 0 END) AS copies,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, middle / target) END AS u FROM p)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END + 1e-9, 6) END AS first_position
FROM c""",
    "op9_line_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l), h AS (
  SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key), j AS (
  SELECT k.*, coalesce(h.holder IS NOT NULL AND (k.doc_id IS NULL OR h.holder < k.doc_id), FALSE) AS gone
  FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id""",
    "op12_k2_treap_search": r"""
WITH t AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)), f AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM t GROUP BY rid, term), n AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM t GROUP BY rid), g AS (
  SELECT count(*)::BIGINT AS docs, coalesce(sum(n), 0)::BIGINT AS terms FROM n), m AS (
  SELECT rid, doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM n, g), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM f WHERE term IN (SELECT term FROM q) GROUP BY term), g), s AS (
  SELECT item_id, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item_id, rid), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM s JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20""",
}
