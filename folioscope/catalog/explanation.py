"""Queries of attributions. Literal coefficients over customer and order aggregates make the
linear case and every view on it checkable in SQL; model-based ones are rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import modelling as mo
from folioscope.operators import attribution as at
from folioscope.operators import metrics as mt
from folioscope.operators import models as md
from folioscope.plans import evaluate as ev
from folioscope.plans import explain as ex
from folioscope.session import cut_lineage, shared_folder
from folioscope.sources import sinks, tables

QUERIES: dict = {}
SQL: dict = {}
HALF = 1e-9
WEIGHTS = [("balance", 0.4), ("orders", -150.0), ("spend", 0.001), ("largest", -0.002), ("open_share", 900.0), ("segment_len", 0.0)]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def r6(*names):
    return [F.round(F.col(n) + HALF, 6).alias(n) for n in names]


ROWS_SQL = """x AS (SELECT c_custkey AS row_id, any_value(c_acctbal) AS balance, count(*)::DOUBLE AS orders, round(sum(o_totalprice), 2) AS spend,
  max(o_totalprice) AS largest, round(avg((o_orderstatus = 'O')::INT), 6) AS open_share, length(any_value(c_mktsegment))::DOUBLE AS segment_len
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), long AS (
  UNPIVOT x ON balance, orders, spend, largest, open_share, segment_len INTO NAME feature VALUE value), wt(feature, weight) AS (VALUES """ + ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in WEIGHTS) + """),
  mu AS (SELECT feature, avg(value) AS m FROM long GROUP BY feature), shap AS (
  SELECT row_id, feature, weight * (value - m) AS shap, value AS feature_value FROM long JOIN wt USING (feature) JOIN mu USING (feature)), imp AS (
  SELECT feature, avg(abs(shap)) AS mean_abs_shap, row_number() OVER (ORDER BY round(avg(abs(shap)), 12) DESC, feature) AS rank FROM shap GROUP BY feature)"""


def customer_rows(spark, sf):
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    o = tables.read_table(spark, sf, "orders", ["o_custkey", "o_totalprice", "o_orderstatus"])
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spend"),
        F.max("o_totalprice").alias("largest"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("int")), 6).alias("open_share"))
    wide = c.join(per, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("balance"), "orders", "spend", "largest", "open_share",
        F.length("c_mktsegment").cast("double").alias("segment_len"))
    return wide.unpivot(["row_id"], [f for f, _ in WEIGHTS], "feature", "value")


def linear_shap(spark, sf):
    weights = spark.createDataFrame(WEIGHTS, "feature string, weight double")
    return at.linear_attributions(customer_rows(spark, sf), weights)


@query("x4_linear_attributions", "WITH " + ROWS_SQL + " SELECT row_id, feature, round(shap + 1e-9, 4) AS shap, feature_value FROM shap")
def x4(spark, sf):
    return linear_shap(spark, sf).withColumn("shap", F.round(F.col("shap") + HALF, 4))


@query("x6_attribution_table", "WITH " + ROWS_SQL + " SELECT row_id, c_mktsegment, feature, round(shap + 1e-9, 4) AS shap, rank FROM shap JOIN imp USING (feature) JOIN customer ON c_custkey = row_id")
def x6(spark, sf):
    from folioscope.plans.reduction import with_clinical
    s = linear_shap(spark, sf)
    meta = tables.read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "row_id")
    ranked = with_clinical(s, meta).join(at.importance(s).select("feature", "rank"), "feature")
    return ranked.select("row_id", "c_mktsegment", "feature", F.round(F.col("shap") + HALF, 4).alias("shap"), "rank")


@query("a35_mean_absolute", "WITH " + ROWS_SQL + " SELECT rank, feature, round(mean_abs_shap + 1e-9, 4) AS mean_abs_shap FROM imp")
def a35(spark, sf):
    return at.importance(linear_shap(spark, sf)).withColumn("mean_abs_shap", F.round(F.col("mean_abs_shap") + HALF, 4))


@query("t3_top_features", "WITH " + ROWS_SQL + " SELECT rank, feature FROM imp WHERE rank <= 5")
def t3(spark, sf):
    return at.top_features(linear_shap(spark, sf), at.TOP_DEPENDENCE).select("rank", "feature")


_SCALED = """sc AS (SELECT *, CASE WHEN max(feature_value) OVER f > min(feature_value) OVER f THEN (feature_value - min(feature_value) OVER f) / (max(feature_value) OVER f - min(feature_value) OVER f) ELSE 0.5 END AS scaled
  FROM shap WINDOW f AS (PARTITION BY feature))"""


@query("w13_scaled_values", "WITH " + ROWS_SQL + ", " + _SCALED + " SELECT row_id, feature, round(scaled + 1e-9, 6) AS scaled FROM sc")
def w13(spark, sf):
    return at.scaled_in_feature(linear_shap(spark, sf)).select("row_id", "feature", *r6("scaled"))


@query("x8_beeswarm", "WITH " + ROWS_SQL + ", " + _SCALED + " SELECT rank, feature, row_id, round(shap + 1e-9, 4) AS shap, round(scaled + 1e-9, 6) AS scaled FROM sc JOIN imp USING (feature) WHERE rank <= 20")
def x8(spark, sf):
    return at.beeswarm(linear_shap(spark, sf)).select("rank", "feature", "row_id", F.round(F.col("shap") + HALF, 4).alias("shap"), *r6("scaled"))


@query("x7_dependence", "WITH " + ROWS_SQL + """, st AS (SELECT i.rank, a.feature, b.feature AS other, coalesce(abs(corr(b.feature_value, a.shap)), 0) AS r
  FROM shap a JOIN imp i ON i.feature = a.feature AND i.rank <= 5 JOIN shap b ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY ALL), best AS (
  SELECT rank, feature, other FROM st QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(-r, 12), other) = 1)
SELECT b.rank, b.feature, b.other AS interaction, a.row_id, a.feature_value, round(a.shap + 1e-9, 4) AS shap, o.feature_value AS interaction_value
FROM best b JOIN shap a ON a.feature = b.feature JOIN shap o ON o.feature = b.other AND o.row_id = a.row_id""")
def x7(spark, sf):
    d = at.dependence(linear_shap(spark, sf))
    return d.select("rank", "feature", "interaction", "row_id", "feature_value", F.round(F.col("shap") + HALF, 4).alias("shap"), "interaction_value")


_CASE_SQL = """tot AS (SELECT row_id, sum(shap) AS s FROM shap GROUP BY row_id), pr AS (
  SELECT row_id, (c_nationkey % 2)::INT AS y_true, round(1 / (1 + exp(-s / 2000)), 6) AS y_prob FROM tot JOIN customer ON c_custkey = row_id), oc AS (
  SELECT *, CASE WHEN y_true = 1 AND y_prob >= 0.5 THEN 'TP' WHEN y_true = 0 AND y_prob < 0.5 THEN 'TN' WHEN y_true = 0 THEN 'FP' ELSE 'FN' END AS outcome FROM pr), md AS (
  SELECT outcome, quantile_cont(y_prob, 0.5) AS med FROM oc GROUP BY outcome), rep AS (
  SELECT outcome, row_id FROM oc JOIN md USING (outcome) QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY round(abs(y_prob - med), 12), row_id) = 1), wf AS (
  SELECT outcome, row_id, feature, shap, row_number() OVER w AS step, sum(shap) OVER w AS total
  FROM shap JOIN rep USING (row_id) JOIN imp USING (feature) WHERE rank <= 15 WINDOW w AS (PARTITION BY outcome ORDER BY round(abs(shap), 12), feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _representatives(spark, sf, shap):
    totals = shap.groupBy("row_id").agg(F.sum("shap").alias("s"))
    c = tables.read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"]).withColumnRenamed("c_custkey", "row_id")
    pred = totals.join(c, "row_id").select(
        F.lit("m").alias("model"), "row_id", (F.col("c_nationkey") % 2).cast("int").alias("y_true"),
        F.round(1 / (1 + F.exp(-F.col("s") / 2000)), 6).alias("y_prob"))
    return mt.representative_rows(pred)


@query("w12_waterfall_steps", "WITH " + ROWS_SQL + ", " + _CASE_SQL + " SELECT outcome, row_id, step, feature, round(shap + 1e-9, 4) AS shap FROM wf")
def w12(spark, sf):
    s = linear_shap(spark, sf)
    return at.waterfall(s, _representatives(spark, sf, s)).select("outcome", "row_id", "step", "feature", F.round(F.col("shap") + HALF, 4).alias("shap"))


@query("x9_waterfall", "WITH " + ROWS_SQL + ", " + _CASE_SQL + " SELECT outcome, step, feature, round(total - shap + 1e-9, 4) AS start, round(total + 1e-9, 4) AS total FROM wf")
def x9(spark, sf):
    s = linear_shap(spark, sf)
    w = at.waterfall(s, _representatives(spark, sf, s))
    return w.select("outcome", "step", "feature", F.round(F.col("start") + HALF, 4).alias("start"), F.round(F.col("total") + HALF, 4).alias("total"))


@query("x3_tree_attributions")
def x3(spark, sf):
    t = mo._quality_table(spark, sf)
    names = _kept(spark, sf)
    fitted = md.fit_classifier("rf", {"n_estimators": 10, "max_depth": 4}, t, 2)
    return at.tree_attributions(fitted, t, names)[0]


@query("x3_boosted_attributions")
def x3b(spark, sf):
    t = mo._quality_table(spark, sf)
    fitted = md.fit_classifier("xgb", {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.2}, t, 2)
    return at.tree_attributions(fitted, t, _kept(spark, sf))[0]


def _kept(spark, sf):
    from folioscope.operators import preprocess as pp
    long, labels = mo.quality(spark, sf)
    state = pp.fit_filters(long, pp.whole_data(labels), mo.DOC_FEATURES)
    return [r["feature"] for r in pp.kept_features(state).orderBy("position").collect()]


@query("x5_kernel_attributions")
def x5(spark, sf):
    t = mo._quality_table(spark, sf)
    fitted = md.fit_classifier("lr", {"C": 1.0, "l1_ratio": 0.0}, t, 2)
    return at.kernel_attributions(fitted, t, _kept(spark, sf), centres=5)


def _cv(spark, sf):
    long, labels = mo.quality(spark, sf)
    plan = ev.Plan(n_outer=2, n_inner=2, model_filter=["dt"], fixed_params={"dt": {"max_depth": 3}}, use_smote=False)
    return long, labels, ev.run_classification(long, mo.DOC_FEATURES, labels, 2, plan)["cv_results"]


@query("x1_refit_best")
def x1(spark, sf):
    long, labels, cv = _cv(spark, sf)
    fitted, rows, _ = ex.refit_best(long, mo.DOC_FEATURES, labels, cv, "classification", 2)
    return fitted.predict(rows).select("row_id", F.lit(fitted.model_id).alias("model"), "y_pred", "y_prob")


@query("x2_transform_without_model")
def x2(spark, sf):
    t = mo._quality_table(spark, sf)
    from pyspark.ml.functions import vector_to_array
    return t.select("row_id", vector_to_array("features").alias("features"))


@query("g5_explain_best")
def g5(spark, sf):
    long, labels, cv = _cv(spark, sf)
    return ex.explain_best(long, mo.DOC_FEATURES, labels, cv, "classification", 2)["shap_values"]


@query("s11_attribution_tables", "WITH " + ROWS_SQL + " SELECT row_id, " + ", ".join(f"max(CASE WHEN feature = '{f}' THEN round(shap + 1e-9, 4) END) AS {f}" for f, _ in WEIGHTS) + " FROM shap GROUP BY row_id")
def s11(spark, sf):
    s = linear_shap(spark, sf).withColumn("shap", F.round(F.col("shap") + HALF, 4))
    wide = sinks.wide_matrix(s, ["row_id"], [f for f, _ in WEIGHTS], value="shap")
    return spark.read.parquet(sinks.write_table(wide, shared_folder(spark), "s11_shap_values"))
