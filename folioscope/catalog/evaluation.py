"""Queries of target checks, splits, weights, metrics and model comparison.

Predictions need no model here: a score mixes the label with md5 noise, so every metric has
an exact SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import scalars as fs
from folioscope.operators import compare as cmp
from folioscope.operators import metrics as mt
from folioscope.operators import splits as sp
from folioscope.operators.ordered import average_ranks
from folioscope.session import shared_folder
from folioscope.sources import sinks, tables

QUERIES: dict = {}
SQL: dict = {}
HALF = 1e-9


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def r6(*names):
    return [F.round(F.col(n) + HALF, 6).alias(n) for n in names]


def rsql(*names):
    return ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)


# ---- inputs ----------------------------------------------------------------------------

MODELS = [("m_a", 0.5), ("m_b", 0.35), ("m_c", 0.2)]
_MODELS_SQL = "models(model, w) AS (VALUES " + ", ".join(f"('{m}', {w}::DOUBLE)" for m, w in MODELS) + ")"


def _u_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def folds_sql(source: str, name: str = "folds", k: int = 5) -> str:
    """CTEs giving (row_id, label, fold) from `source`(row_id, label)."""
    return f"""{name}_n AS (SELECT label, count(*) AS n FROM {source} GROUP BY label), {name}_b AS (
  SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM {name}_n), {name} AS (
  SELECT s.*, ((b + row_number() OVER (PARTITION BY s.label ORDER BY md5('42|' || row_id), row_id) - 1) % {k})::INT AS fold
  FROM {source} s JOIN {name}_b USING (label))"""


_LABELLED_SQL = "labelled AS (SELECT c_custkey AS row_id, (c_acctbal > 4500)::INT AS label FROM customer)"
PRED_SQL = _LABELLED_SQL + ", " + folds_sql("labelled") + ", " + _MODELS_SQL + f""", pred AS (
  SELECT fold, model, row_id, label AS y_true, y_prob, (y_prob >= 0.5)::INT AS y_pred FROM (
    SELECT *, round(w * label + (1 - w) * {_u_sql("model || '|' || row_id")}, 3) AS y_prob FROM folds, models))"""
RANKED_SQL = """ranked AS (
  SELECT *, rank() OVER (PARTITION BY fold, model ORDER BY y_prob)
    + (count(*) OVER (PARTITION BY fold, model, y_prob) - 1) / 2.0 AS r FROM pred), auc AS (
  SELECT fold, model, (sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true) * (sum(y_true) + 1) / 2.0)
    / (sum(y_true) * sum(1 - y_true)) AS auc_roc FROM ranked GROUP BY fold, model)"""
CV_SQL = PRED_SQL + ", " + RANKED_SQL + """, cv AS (
  SELECT fold, model, round(auc_roc + 1e-9, 6) AS auc_roc, 'depth=' || floor(auc_roc * 20)::INT AS best_params FROM auc)"""


def labelled(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    return c.select(F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") > 4500).cast("int").alias("label"))


def _per_model(df):
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("w")) for m, w in MODELS])
    return df.withColumn("_m", F.explode(models)).select("*", "_m.model", "_m.w").drop("_m")


def predictions(spark, sf):
    rows = _per_model(sp.stratified_folds(labelled(spark, sf), "row_id", "label", 5))
    u = fs.hash_unit(F.col("model"), F.col("row_id"))
    scored = rows.withColumn("y_prob", F.round(F.col("w") * F.col("label") + (1 - F.col("w")) * u, 3))
    return scored.select("fold", "model", "row_id", F.col("label").alias("y_true"),
                         (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"), "y_prob")


def cv_table(spark, sf):
    a = mt.auc(predictions(spark, sf))
    return a.select("fold", "model", F.round(F.col("auc_roc") + HALF, 6).alias("auc_roc"),
                    F.concat(F.lit("depth="), F.floor(F.col("auc_roc") * 20).cast("int")).alias("best_params"))


REG_SQL = "all_rows AS (SELECT c_custkey AS row_id, 0 AS label, c_acctbal FROM customer), " + folds_sql("all_rows") + ", " + _MODELS_SQL + f""", pred AS (
  SELECT fold, model, row_id, c_acctbal AS y_true,
         round(w * c_acctbal + (1 - w) * 10000 * {_u_sql("model || '|' || row_id")}, 1) AS y_pred FROM folds, models)"""


def reg_predictions(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"]).withColumnRenamed("c_custkey", "row_id")
    rows = _per_model(sp.shuffled_folds(c, "row_id", 5))
    u = fs.hash_unit(F.col("model"), F.col("row_id"))
    return rows.select(
        "fold", "model", "row_id", F.col("c_acctbal").alias("y_true"),
        F.round(F.col("w") * F.col("c_acctbal") + (1 - F.col("w")) * 10000 * u, 1).alias("y_pred"))


MULTI_SQL = "labelled AS (SELECT c_custkey AS row_id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM customer), " + folds_sql("labelled") + ", " + _MODELS_SQL + f""", raw AS (
  SELECT fold, model, row_id, label AS y_true, class, {_u_sql("model || '|' || row_id || '|' || class")} + w * (class = label)::INT AS s
  FROM folds, models, (SELECT unnest(range(5)) AS class)), probs AS (
  SELECT *, round(s / sum(s) OVER (PARTITION BY model, row_id), 6) AS y_prob FROM raw), pred AS (
  SELECT fold, model, row_id, y_true, arg_max(class, y_prob)::INT AS y_pred, max(y_prob) AS y_prob FROM probs GROUP BY ALL)"""


def multi_predictions(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    codes = sinks.label_map(c, "c_mktsegment")
    lab = c.join(codes, F.col("c_mktsegment") == F.col("label")).select(
        F.col("c_custkey").alias("row_id"), F.col("encoded").alias("label"))
    rows = _per_model(sp.stratified_folds(lab, "row_id", "label", 5))
    # The folds come in few small partitions; the scores below are the work.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id", "model")
    raw = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: fs.hash_unit(F.col("model"), F.col("row_id"), k)
                      + F.when(k == F.col("label"), F.col("w")).otherwise(0.0))
    rows = rows.withColumn("_raw", raw).withColumn("_sum", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("probs", F.transform("_raw", lambda x: F.round(x / F.col("_sum"), 6)))
    return rows.select(
        "fold", "model", "row_id", F.col("label").alias("y_true"),
        (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("y_pred"),
        F.array_max("probs").alias("y_prob"), "probs")


_NOISY_SQL = """noisy AS (SELECT c_custkey AS row_id, c_acctbal,
  CASE WHEN c_acctbal < 0 THEN ' NaN' WHEN c_nationkey = 3 THEN '  ' WHEN c_nationkey = 4 THEN NULL
       WHEN c_nationkey = 5 THEN 'nan' ELSE c_mktsegment END AS segment,
  CASE WHEN c_nationkey = 6 THEN 'bad' WHEN c_nationkey = 7 THEN 'NaN' WHEN c_nationkey = 8 THEN NULL
       ELSE CAST(c_acctbal AS VARCHAR) END AS balance_text,
  CASE WHEN c_nationkey <> 9 THEN c_acctbal END AS balance,
  CASE WHEN c_acctbal > 1e9 THEN 1.0 END AS nothing,
  'same' AS constant
  FROM customer)"""


def noisy(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nk = F.col("c_nationkey")
    return c.select(
        F.col("c_custkey").alias("row_id"), "c_acctbal",
        F.when(F.col("c_acctbal") < 0, " NaN").when(nk == 3, "  ").when(nk == 4, None).when(nk == 5, "nan").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(nk == 6, "bad").when(nk == 7, "NaN").when(nk == 8, None).otherwise(F.col("c_acctbal").cast("string")).alias("balance_text"),
        F.when(nk != 9, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_acctbal") > 1e9, 1.0).alias("nothing"), F.lit("same").alias("constant"))


_OK_LABEL = "{c} IS NOT NULL AND trim({c}) <> '' AND lower({c}) <> 'nan'"
_NUM = "CASE WHEN NOT isnan(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END"


# ---- targets ---------------------------------------------------------------------------

@query("p7_target_type", "WITH " + _NOISY_SQL + """
SELECT 'segment' AS target, 'classification' AS task UNION ALL SELECT 'balance_text', 'classification' UNION ALL
SELECT 'balance', CASE WHEN count(balance) = 0 THEN 'classification' ELSE 'regression' END FROM noisy UNION ALL
SELECT 'nothing', CASE WHEN count(nothing) = 0 THEN 'classification' ELSE 'regression' END FROM noisy""")
def p7(spark, sf):
    return sp.target_types(noisy(spark, sf), ["segment", "balance_text", "balance", "nothing"])


@query("p8_valid_target", "WITH " + _NOISY_SQL + f"""
SELECT row_id, {_OK_LABEL.format(c='segment')} AS segment_ok, ({_NUM.format(c='balance_text')}) IS NOT NULL AS balance_ok FROM noisy""")
def p8(spark, sf):
    return noisy(spark, sf).select(
        "row_id", sp.valid_target("segment", "classification").alias("segment_ok"),
        sp.valid_target("balance_text", "regression").alias("balance_ok"))


@query("p9_numeric_coercion", "WITH " + _NOISY_SQL + f" SELECT row_id, {_NUM.format(c='balance_text')} AS value FROM noisy")
def p9(spark, sf):
    return noisy(spark, sf).select("row_id", fs.clean_double("balance_text").alias("value"))


_GATE = """SELECT '{t}' AS target, '{k}' AS task, count(CASE WHEN {ok} THEN 1 END) AS n_valid, {cl} AS n_classes FROM noisy"""


@query("p10_target_gates", "WITH " + _NOISY_SQL + ", g AS (" + " UNION ALL ".join([
    _GATE.format(t="segment", k="classification", ok=_OK_LABEL.format(c="segment"), cl="count(DISTINCT CASE WHEN " + _OK_LABEL.format(c="segment") + " THEN segment END)"),
    _GATE.format(t="constant", k="classification", ok="true", cl="count(DISTINCT constant)"),
    _GATE.format(t="balance_text", k="regression", ok="(" + _NUM.format(c="balance_text") + ") IS NOT NULL", cl="NULL::BIGINT"),
    _GATE.format(t="nothing", k="regression", ok="nothing IS NOT NULL", cl="NULL::BIGINT"),
]) + """) SELECT *, CASE WHEN n_valid < 10 THEN 'too few valid rows' WHEN n_classes < 2 THEN 'only one class' END AS skip_reason FROM g""")
def p10(spark, sf):
    return sp.target_gate(noisy(spark, sf), {
        "segment": "classification", "constant": "classification", "balance_text": "regression", "nothing": "regression"})


@query("s8_label_encoding", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS encoded FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)")
def s8(spark, sf):
    codes = sinks.label_map(tables.read_table(spark, sf, "customer", ["c_mktsegment"]), "c_mktsegment")
    path = sinks.write_table(codes, shared_folder(spark), "s8_label_encoding")
    return spark.read.parquet(path)


@query("j9_label_lookup", "SELECT c_custkey AS row_id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS encoded FROM customer")
def j9(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    codes = sinks.label_map(c, "c_mktsegment")
    return c.join(codes, F.col("c_mktsegment") == F.col("label")).select(F.col("c_custkey").alias("row_id"), "encoded")


# ---- strata and folds ------------------------------------------------------------------

_TERT_SQL = """scored AS (SELECT c_custkey AS row_id, c_mktsegment AS label, CASE WHEN c_nationkey <> 9 THEN c_acctbal END AS v FROM customer),
e AS (SELECT quantile_cont(v, 1.0::DOUBLE / 3) AS a, quantile_cont(v, 2.0::DOUBLE / 3) AS b FROM scored),
binned AS (SELECT row_id, label, CASE WHEN v IS NULL THEN NULL WHEN v <= a THEN 'low' WHEN v <= b THEN 'med' ELSE 'high' END AS bin FROM scored, e)"""


def _scored(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"])
    return c.select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("label"),
                    F.when(F.col("c_nationkey") != 9, F.col("c_acctbal")).alias("v"))


@query("w1_tertile_bins", "WITH " + _TERT_SQL + " SELECT row_id, bin FROM binned")
def w1(spark, sf):
    return sp.tertile_bins(_scored(spark, sf), "v").select("row_id", "bin")


@query("w1_tertile_fallback", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.07 THEN 0.02 ELSE l_discount END AS v FROM lineitem),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN v > lo + (hi - lo) / 3 * 2 THEN 'high' WHEN v > lo + (hi - lo) / 3 THEN 'med' ELSE 'low' END AS bin FROM t, m""")
def w1b(spark, sf):
    # Most values coincide, so the tertile edges do too.
    li = tables.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount"])
    flat = li.withColumn("v", F.when(F.col("l_discount") <= 0.07, 0.02).otherwise(F.col("l_discount")))
    return sp.tertile_bins(flat, "v").select("l_orderkey", "l_linenumber", "bin")


@query("w2_quintile_bins", """WITH v AS (SELECT c_custkey AS row_id, CASE WHEN c_nationkey <> 9 THEN c_acctbal END AS v FROM customer),
e AS (SELECT quantile_cont(v, 0.2) AS a, quantile_cont(v, 0.4) AS b, quantile_cont(v, 0.6) AS c, quantile_cont(v, 0.8) AS d FROM v)
SELECT row_id, CASE WHEN v IS NULL THEN -1 ELSE (v > a)::INT + (v > b)::INT + (v > c)::INT + (v > d)::INT END AS bin FROM v, e""")
def w2(spark, sf):
    return sp.quantile_bins(_scored(spark, sf), "v").select("row_id", "bin")


@query("w2_quintile_ties", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 25 THEN 1.0 ELSE l_quantity END AS v FROM lineitem),
q AS (SELECT quantile_cont(v, 0.6) AS c, quantile_cont(v, 0.8) AS d FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN v > d THEN 2 WHEN v > c THEN 1 ELSE 0 END AS bin FROM t, q""")
def w2b(spark, sf):
    # Half of the values coincide: the lower edges collapse into one bin.
    li = tables.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    tied = li.withColumn("v", F.when(F.col("l_quantity") <= 25, 1.0).otherwise(F.col("l_quantity")))
    return sp.quantile_bins(tied, "v").select("l_orderkey", "l_linenumber", "bin")


@query("w3_joint_stratum", "WITH " + _TERT_SQL + " SELECT row_id, label || '_' || coalesce(bin, 'noados') AS stratum FROM binned")
def w3(spark, sf):
    return sp.joint_stratum(_scored(spark, sf), "label", "v").select("row_id", "stratum")


@query("w4_label_stratum", "WITH " + _LABELLED_SQL + " SELECT row_id, label AS stratum FROM labelled")
def w4(spark, sf):
    return labelled(spark, sf).select("row_id", F.col("label").cast("int").alias("stratum"))


@query("w5_stratified_folds", "WITH " + _LABELLED_SQL + ", " + folds_sql("labelled") + " SELECT row_id, label, fold FROM folds")
def w5(spark, sf):
    return sp.stratified_folds(labelled(spark, sf), "row_id", "label", 5)


@query("w6_plain_folds", "WITH all_rows AS (SELECT o_orderkey AS row_id, 0 AS label FROM orders), " + folds_sql("all_rows", k=3) + " SELECT row_id, fold FROM folds")
def w6(spark, sf):
    o = tables.read_table(spark, sf, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "row_id")
    return sp.shuffled_folds(o, "row_id", 3)


@query("w7_nested_folds", "WITH " + _LABELLED_SQL + ", " + folds_sql("labelled") + """,
train AS (SELECT f.row_id, f.label, o.outer_fold FROM folds f, (SELECT unnest(range(5))::INT AS outer_fold) o WHERE o.outer_fold <> f.fold),
n AS (SELECT outer_fold, label, count(*) AS n FROM train GROUP BY ALL),
b AS (SELECT outer_fold, label, coalesce(sum(n) OVER (PARTITION BY outer_fold ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
SELECT row_id, label, outer_fold, ((b + row_number() OVER (PARTITION BY outer_fold, label ORDER BY md5('42|' || row_id), row_id) - 1) % 3)::INT AS inner_fold
FROM train JOIN b USING (outer_fold, label)""")
def w7(spark, sf):
    return sp.nested_folds(labelled(spark, sf), "row_id", "label", 5, 3, inner_stratum="label")


@query("w8_average_ranks", "WITH " + PRED_SQL + ", " + RANKED_SQL + " SELECT fold, model, row_id, r AS avg_rank FROM ranked")
def w8(spark, sf):
    p = predictions(spark, sf)
    ranks = average_ranks(p, ["fold", "model"], "y_prob").select("fold", "model", "y_prob", "avg_rank")
    return p.join(ranks, ["fold", "model", "y_prob"]).select("fold", "model", "row_id", "avg_rank")


@query("a34_class_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def a34(spark, sf):
    return sp.class_counts(tables.read_table(spark, sf, "labels", ["quality"]), "quality")


@query("r2_adaptive_neighbours", "WITH q AS (SELECT doc_id AS row_id, quality AS label FROM labels), " + folds_sql("q") + """,
n AS (SELECT outer_fold, label, count(*) AS n FROM folds, (SELECT unnest(range(5))::INT AS outer_fold) WHERE fold <> outer_fold GROUP BY ALL)
SELECT outer_fold, min(n) AS smallest_class, greatest(1, least(5, min(n) - 1))::INT AS k_neighbors FROM n GROUP BY outer_fold""")
def r2(spark, sf):
    q = tables.read_table(spark, sf, "labels", ["doc_id", "quality"]).select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    train = sp.training_rows(sp.stratified_folds(q, "row_id", "label", 5), 5)
    return sp.oversampling_neighbours(train, "label", ["outer_fold"])


@query("r4_balanced_weights", """WITH n AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY ALL)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE + 1e-9, 6) AS weight FROM n""")
def r4(spark, sf):
    q = tables.read_table(spark, sf, "labels", ["quality"]).withColumnRenamed("quality", "label")
    return sp.balanced_weights(q, "label").select("label", "n", *r6("weight"))


# ---- metrics ---------------------------------------------------------------------------

@query("a40_auc", "WITH " + PRED_SQL + ", " + RANKED_SQL + f" SELECT fold, model, {rsql('auc_roc')} FROM auc")
def a40(spark, sf):
    return mt.auc(predictions(spark, sf)).select("fold", "model", *r6("auc_roc"))


@query("a41_auc_one_vs_rest", "WITH " + MULTI_SQL + """, ranked AS (
  SELECT *, (class = y_true)::INT AS pos, rank() OVER (PARTITION BY fold, model, class ORDER BY y_prob)
    + (count(*) OVER (PARTITION BY fold, model, class, y_prob) - 1) / 2.0 AS r FROM probs), a AS (
  SELECT fold, model, class, (sum(CASE WHEN pos = 1 THEN r END) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)) AS auc
  FROM ranked GROUP BY ALL)
SELECT fold, model, round(avg(auc) + 1e-9, 6) AS auc_roc FROM a GROUP BY ALL""")
def a41(spark, sf):
    return mt.auc_one_vs_rest(multi_predictions(spark, sf), "probs", 5).select("fold", "model", *r6("auc_roc"))


_CLASS_SQL = """cls AS (
  SELECT fold, model, class, count(CASE WHEN y_true = class THEN 1 END) AS support,
    count(CASE WHEN y_true = class AND y_pred = class THEN 1 END) AS tp, count(CASE WHEN y_pred = class THEN 1 END) AS predicted
  FROM pred, (SELECT unnest(range({k})) AS class) GROUP BY ALL), sc AS (
  SELECT *, CASE WHEN support > 0 THEN tp / support END AS recall,
    CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END AS f1
  FROM cls WHERE support + predicted > 0)"""


@query("a42_balanced_accuracy", "WITH " + MULTI_SQL + ", " + _CLASS_SQL.format(k=5) + " SELECT fold, model, round(avg(recall) + 1e-9, 6) AS balanced_acc FROM sc GROUP BY ALL")
def a42(spark, sf):
    return mt.class_scores(multi_predictions(spark, sf)).groupBy("fold", "model").agg(
        F.round(F.avg("recall") + HALF, 6).alias("balanced_acc"))


@query("a43_f1", "WITH " + MULTI_SQL + ", " + _CLASS_SQL.format(k=5) + " SELECT fold, model, round(avg(f1) + 1e-9, 6) AS f1_macro, round(sum(f1 * support) / sum(support) + 1e-9, 6) AS f1_weighted FROM sc GROUP BY ALL")
def a43(spark, sf):
    p = multi_predictions(spark, sf)
    return mt.classification_scores(p, 5, probs="probs").select("fold", "model", *r6("f1_macro", "f1_weighted"))


@query("a44_sensitivity_specificity", "WITH " + PRED_SQL + """ SELECT fold, model,
round(sum(y_true * y_pred) / sum(y_true) + 1e-9, 6) AS sensitivity,
round(sum((1 - y_true) * (1 - y_pred)) / sum(1 - y_true) + 1e-9, 6) AS specificity FROM pred GROUP BY ALL""")
def a44(spark, sf):
    return mt.classification_scores(predictions(spark, sf), 2).select("fold", "model", *r6("sensitivity", "specificity"))


_STEPS_SQL = """steps AS (
  SELECT fold, model, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM pred GROUP BY ALL), cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg,
    lead(pos) OVER (PARTITION BY fold, model ORDER BY y_prob DESC) AS np, lead(neg) OVER (PARTITION BY fold, model ORDER BY y_prob DESC) AS nn,
    row_number() OVER (PARTITION BY fold, model ORDER BY y_prob DESC) AS rn
  FROM steps WINDOW w AS (PARTITION BY fold, model ORDER BY y_prob DESC), g AS (PARTITION BY fold, model)), pts AS (
  SELECT fold, model, fp::BIGINT AS fp, tp::BIGINT AS tp, n_neg, n_pos, y_prob AS threshold FROM cum WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
  UNION ALL SELECT fold, model, 0, 0, n_neg, n_pos, 'inf'::DOUBLE FROM cum WHERE rn = 1)"""


@query("w9_cumulative_steps", "WITH " + PRED_SQL + ", " + _STEPS_SQL + " SELECT fold, model, y_prob, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cum")
def w9(spark, sf):
    s = mt.score_steps(predictions(spark, sf))
    return s.select("fold", "model", "y_prob", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))


@query("a45_roc_points", "WITH " + PRED_SQL + ", " + _STEPS_SQL + """ SELECT fold, model, round(fp / n_neg + 1e-9, 6) AS fpr, round(tp / n_pos + 1e-9, 6) AS tpr,
CASE WHEN threshold < 2 THEN threshold ELSE 2 END AS threshold FROM pts""")
def a45(spark, sf):
    # The start's infinite threshold is shown as 2, which no probability reaches.
    p = mt.roc_points(mt.score_steps(predictions(spark, sf)))
    return p.select("fold", "model", *r6("fpr", "tpr"), F.least("threshold", F.lit(2.0)).alias("threshold"))


_GRID_SQL = _STEPS_SQL + """, curves AS (SELECT DISTINCT fold, model, n_neg, n_pos FROM pts), lo AS (
  SELECT c.fold, c.model, g, max({'x': p.fp, 'y': p.tp}) AS l, any_value(c.n_neg) AS n_neg, any_value(c.n_pos) AS n_pos
  FROM curves c CROSS JOIN (SELECT unnest(range(101)) AS g) JOIN pts p ON p.fold = c.fold AND p.model = c.model AND p.fp * 100 <= g * c.n_neg GROUP BY ALL), hi AS (
  SELECT c.fold, c.model, g, min({'x': p.fp, 'y': p.tp}) AS r
  FROM curves c CROSS JOIN (SELECT unnest(range(101)) AS g) JOIN pts p ON p.fold = c.fold AND p.model = c.model AND p.fp * 100 > g * c.n_neg GROUP BY ALL), grid AS (
  SELECT fold, model, g, CASE WHEN g = 0 THEN 0.0 ELSE (l.y + coalesce((r.y - l.y) / (r.x - l.x)::DOUBLE * (g * n_neg / 100.0 - l.x), 0)) / n_pos END AS tpr
  FROM lo LEFT JOIN hi USING (fold, model, g))"""


@query("j10_tpr_on_grid", "WITH " + PRED_SQL + ", " + _GRID_SQL + " SELECT fold, model, g::BIGINT AS step, round(tpr + 1e-9, 6) AS tpr FROM grid")
def j10(spark, sf):
    pts = mt.roc_points(mt.score_steps(predictions(spark, sf)))
    return mt.tpr_on_grid(pts).select("fold", "model", "step", *r6("tpr"))


@query("a46_mean_roc", "WITH " + PRED_SQL + ", " + RANKED_SQL + ", " + _GRID_SQL + """, area AS (
  SELECT model, avg(auc_roc) AS ma, stddev_pop(auc_roc) AS sa FROM auc GROUP BY model)
SELECT model, g / 100.0 AS fpr, round(CASE WHEN g = 100 THEN 1.0 ELSE avg(tpr) END + 1e-9, 6) AS mean_tpr,
  round(stddev_pop(tpr) + 1e-9, 6) AS std_tpr, round(any_value(ma) + 1e-9, 6) AS mean_auc, round(any_value(sa) + 1e-9, 6) AS std_auc
FROM grid JOIN area USING (model) GROUP BY model, g""")
def a46(spark, sf):
    return mt.mean_roc(predictions(spark, sf)).select("model", "fpr", *r6("mean_tpr", "std_tpr", "mean_auc", "std_auc"))


@query("a33_confusion_matrix", "WITH " + MULTI_SQL + """ SELECT model, y_true, y_pred, count(row_id) AS n FROM
(SELECT model, t::INT AS y_true, p::INT AS y_pred FROM models, (SELECT unnest(range(5)) AS t), (SELECT unnest(range(5)) AS p))
LEFT JOIN pred USING (model, y_true, y_pred) GROUP BY ALL""")
def a33(spark, sf):
    return mt.confusion_matrix(multi_predictions(spark, sf), 5)


@query("a53_row_probability", "WITH " + MULTI_SQL + " SELECT fold, model, row_id, y_pred, y_prob FROM pred")
def a53(spark, sf):
    return multi_predictions(spark, sf).select("fold", "model", "row_id", "y_pred", "y_prob")


_ERR_SQL = """sqrt(avg((y_pred - y_true) ^ 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae,
1 - avg((y_pred - y_true) ^ 2) / var_pop(y_true) AS r2"""


@query("a47_errors", "WITH " + REG_SQL + f", e AS (SELECT fold, model, {_ERR_SQL} FROM pred GROUP BY fold, model) SELECT fold, model, {rsql('rmse', 'mae', 'r2')} FROM e")
def a47(spark, sf):
    return mt.regression_errors(reg_predictions(spark, sf)).select("fold", "model", *r6("rmse", "mae", "r2"))


def _corr_sql(keys):
    part = ", ".join(keys)
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY y_true) + (count(*) OVER (PARTITION BY {part}, y_true) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY {part} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {part}, y_pred) - 1) / 2.0 AS rp FROM pred), c AS (
  SELECT {part}, corr(y_true, y_pred) AS pearson_r, corr(rt, rp) AS spearman_r, {_ERR_SQL} FROM rk GROUP BY {part})"""


@query("a48_correlations", "WITH " + REG_SQL + ", " + _corr_sql(["fold", "model"]) + f" SELECT fold, model, {rsql('pearson_r', 'spearman_r')} FROM c")
def a48(spark, sf):
    p = reg_predictions(spark, sf)
    return mt.regression_errors(p).join(mt.spearman(p), ["fold", "model"]).select("fold", "model", *r6("pearson_r", "spearman_r"))


@query("a49_correlation_p")
def a49(spark, sf):
    return mt.regression_scores(reg_predictions(spark, sf)).select("fold", "model", "n", "pearson_r", "pearson_p", "spearman_r", "spearman_p")


@query("a50_residual_rows", "WITH " + REG_SQL + """ SELECT fold, model, row_id, y_true, y_pred, round(y_pred - y_true + 1e-9, 6) AS residual, c_mktsegment AS diagnosis
FROM pred JOIN customer ON c_custkey = row_id""")
def a50(spark, sf):
    meta = tables.read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"]).toDF("row_id", "diagnosis")
    return mt.residual_rows(reg_predictions(spark, sf)).join(meta, "row_id").select(
        "fold", "model", "row_id", "y_true", "y_pred", *r6("residual"), "diagnosis")


@query("a54_pooled_scores", "WITH " + REG_SQL + ", " + _corr_sql(["model"]) + f" SELECT model, {rsql('rmse', 'r2', 'spearman_r', 'pearson_r')} FROM c")
def a54(spark, sf):
    p = reg_predictions(spark, sf)
    return mt.regression_errors(p, ["model"]).join(mt.spearman(p, ["model"]), "model").select("model", *r6("rmse", "r2", "spearman_r", "pearson_r"))


@query("a36_fitted_line", "WITH " + REG_SQL + " SELECT model, round(regr_slope(y_pred, y_true) + 1e-9, 6) AS slope, round(regr_intercept(y_pred, y_true) + 1e-9, 4) AS intercept FROM pred GROUP BY model")
def a36(spark, sf):
    return mt.fitted_line(reg_predictions(spark, sf)).select("model", *r6("slope"), F.round(F.col("intercept") + HALF, 4).alias("intercept"))


@query("a37_residual_histogram", "WITH " + REG_SQL + """, r AS (SELECT model, y_pred - y_true AS residual FROM pred),
s AS (SELECT model, min(residual) AS lo, max(residual) AS hi FROM r GROUP BY model)
SELECT model, least(floor((residual - lo) / (hi - lo) * 20) + 1, 20)::BIGINT AS bin, count(*) AS n FROM r JOIN s USING (model) GROUP BY ALL""")
def a37(spark, sf):
    return mt.residual_histogram(reg_predictions(spark, sf)).withColumn("bin", F.col("bin").cast("bigint"))


@query("a38_target_range", "SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_acctbal) AS n FROM customer")
def a38(spark, sf):
    return tables.read_table(spark, sf, "customer", ["c_acctbal"]).agg(
        F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("c_acctbal").alias("n"))


# ---- results over folds ----------------------------------------------------------------

@query("a30_metric_summary", "WITH " + CV_SQL + """ SELECT model, round(avg(auc_roc) + 1e-9, 6) AS auc_roc_mean, round(stddev_pop(auc_roc) + 1e-9, 6) AS auc_roc_std,
round(stddev_samp(auc_roc) + 1e-9, 6) AS auc_roc_std_sample FROM cv GROUP BY model""")
def a30(spark, sf):
    return mt.metric_summary(cv_table(spark, sf), "auc_roc").select("model", *r6("auc_roc_mean", "auc_roc_std", "auc_roc_std_sample"))


@query("a31_best_model", "WITH " + CV_SQL + " SELECT model, round(avg(auc_roc) + 1e-9, 6) AS value FROM cv GROUP BY model ORDER BY avg(auc_roc) DESC, model LIMIT 1")
def a31(spark, sf):
    return mt.best_model(cv_table(spark, sf), "auc_roc").select("model", *r6("value"))


@query("a32_modal_parameters", "WITH " + CV_SQL + """, n AS (SELECT model, best_params, count(*) AS n FROM cv GROUP BY ALL)
SELECT model, best_params FROM n QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, best_params) = 1""")
def a32(spark, sf):
    return cv_table(spark, sf).groupBy("model").agg(F.mode("best_params", True).alias("best_params"))


@query("t4_leaderboard", "WITH " + CV_SQL + " SELECT model, round(avg(auc_roc) + 1e-9, 6) AS auc_roc_mean, round(stddev_pop(auc_roc) + 1e-9, 6) AS auc_roc_std FROM cv GROUP BY model ORDER BY auc_roc_mean DESC")
def t4(spark, sf):
    return mt.leaderboard(cv_table(spark, sf), "auc_roc").select("model", *r6("auc_roc_mean", "auc_roc_std"))


_PAIRS_SQL = CV_SQL + ", pairs AS (SELECT a.fold, a.model AS m1, b.model AS m2, a.auc_roc AS v1, b.auc_roc AS v2 FROM cv a JOIN cv b ON a.fold = b.fold AND a.model < b.model)"


@query("j5_model_pairs", "WITH " + _PAIRS_SQL + " SELECT * FROM pairs")
def j5(spark, sf):
    return cmp.model_pairs(cv_table(spark, sf), "auc_roc")


_WILCOXON_SQL = _PAIRS_SQL + """, d AS (SELECT m1, m2, round(v1 - v2, 12) AS d, abs(v1 - v2) <= 1e-8 + 1e-5 * abs(v2) AS close FROM pairs), r AS (
  SELECT m1, m2, d, rank() OVER (PARTITION BY m1, m2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY m1, m2, abs(d)) - 1) / 2.0 AS r,
    row_number() OVER (PARTITION BY m1, m2 ORDER BY abs(d)) - 1 AS i FROM d WHERE d <> 0), w AS (
  SELECT m1, m2, count(*) AS n, greatest(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS far FROM r GROUP BY ALL), pat AS (
  SELECT w.m1, w.m2, n, far, code, sum(CASE WHEN (code >> i::INT) & 1 = 1 THEN r.r ELSE 0 END) AS s
  FROM w JOIN r USING (m1, m2), (SELECT unnest(range(4096)) AS code) WHERE code < 2 ^ n GROUP BY ALL), p AS (
  SELECT m1, m2, least(1.0, 2.0 * count(CASE WHEN s >= far - 1e-9 THEN 1 END) / (2 ^ any_value(n))) AS p FROM pat GROUP BY ALL), wil AS (
  SELECT m1, m2, CASE WHEN bool_and(close) OR count(*) < 2 THEN 1.0 ELSE any_value(p) END AS p FROM d LEFT JOIN p USING (m1, m2) GROUP BY m1, m2)"""


@query("a51_wilcoxon", "WITH " + _WILCOXON_SQL + " SELECT m1, m2, round(p::DOUBLE, 6) AS p FROM wil")
def a51(spark, sf):
    return cmp.wilcoxon(cmp.model_pairs(cv_table(spark, sf), "auc_roc")).select("m1", "m2", F.round("p", 6).alias("p"))


@query("a52_comparison_table", "WITH " + _WILCOXON_SQL + """, bonf AS (SELECT m1, m2, least(p * count(*) OVER (), 1.0)::DOUBLE AS pb FROM wil), both_ways AS (
  SELECT m1 AS model, m2 AS other, pb FROM bonf UNION ALL SELECT m2, m1, pb FROM bonf), s AS (
  SELECT model, avg(auc_roc) AS m, stddev_pop(auc_roc) AS sd FROM cv GROUP BY model)
SELECT model, round(any_value(m) + 1e-9, 6) AS auc_roc_mean, round(any_value(sd) + 1e-9, 6) AS auc_roc_std,
  max(CASE WHEN other = 'm_a' THEN round(pb, 6) END) AS p_vs_m_a_bonf, max(CASE WHEN other = 'm_b' THEN round(pb, 6) END) AS p_vs_m_b_bonf,
  max(CASE WHEN other = 'm_c' THEN round(pb, 6) END) AS p_vs_m_c_bonf
FROM s JOIN both_ways USING (model) GROUP BY model""")
def a52(spark, sf):
    t = cmp.comparison_table(cv_table(spark, sf), "auc_roc", [m for m, _ in MODELS])
    return t.select("model", *r6("auc_roc_mean", "auc_roc_std"), *[F.round(f"p_vs_{m}_bonf", 6).alias(f"p_vs_{m}_bonf") for m, _ in MODELS])


@query("w11_representative_rows", "WITH " + PRED_SQL + """, o AS (
  SELECT *, CASE WHEN y_true = 1 AND y_prob >= 0.5 THEN 'TP' WHEN y_true = 0 AND y_prob < 0.5 THEN 'TN' WHEN y_true = 0 THEN 'FP' ELSE 'FN' END AS outcome FROM pred),
m AS (SELECT model, outcome, quantile_cont(y_prob, 0.5) AS med FROM o GROUP BY ALL)
SELECT model, outcome, row_id, y_prob, round(med, 6) AS median_prob FROM o JOIN m USING (model, outcome)
QUALIFY row_number() OVER (PARTITION BY model, outcome ORDER BY round(abs(y_prob - med), 12), row_id) = 1""")
def w11(spark, sf):
    return mt.representative_rows(predictions(spark, sf)).withColumn("median_prob", F.round("median_prob", 6))


@query("j3_predictions_with_entity", "WITH " + PRED_SQL + " SELECT fold, model, c_name AS uuid, y_true, y_pred, y_prob AS y_prob_pos FROM pred JOIN customer ON c_custkey = row_id")
def j3(spark, sf):
    names = tables.read_table(spark, sf, "customer", ["c_custkey", "c_name"]).toDF("row_id", "uuid")
    return predictions(spark, sf).join(names, "row_id").select("fold", "model", "uuid", "y_true", "y_pred", F.col("y_prob").alias("y_prob_pos"))


@query("u1_fold_union", "WITH " + PRED_SQL + " SELECT model, fold, count(*) AS n FROM pred GROUP BY ALL")
def u1(spark, sf):
    p = predictions(spark, sf)
    per_fold = [p.where(F.col("fold") == f) for f in range(5)]
    out = per_fold[0]
    for part in per_fold[1:]:
        out = out.unionByName(part)
    return out.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("s9_result_tables", "WITH " + CV_SQL + """ SELECT 'cv_results' AS kind, 'classification' AS task, 'rich' AS target, model, fold::INT AS fold, count(*) AS n FROM cv GROUP BY ALL
UNION ALL SELECT 'predictions', 'classification', 'rich', model, fold::INT, count(*) FROM pred GROUP BY ALL""")
def s9(spark, sf):
    p = predictions(spark, sf)
    paths = sinks.write_results({"predictions": p, "cv_results": cv_table(spark, sf)}, shared_folder(spark) + "/s9", "classification", "rich")
    parts = [
        spark.read.parquet(path).groupBy("task", "target", "model", "fold").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        for kind, path in paths.items()
    ]
    return parts[0].unionByName(parts[1])
