"""Queries of the column profile and the preprocessing chain.

The matrix is the supplier feature matrix plus four planted columns: a doubled feature, a
constant, one with 40 % and one with 20 % missing values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import bindings as b
from folioscope.catalog.evaluation import folds_sql
from folioscope.functions import scalars as fs
from folioscope.operators import preprocess as pp
from folioscope.operators.foldsums import cells_of_folds
from folioscope.operators import splits as sp
from folioscope.session import derived_once, shared_folder
from folioscope.sources import sinks

QUERIES: dict = {}
SQL: dict = {}
HALF = 1e-9
FEATURES = b.FEATURES + ["twin__raw__mean", "flat__raw__mean", "holes__raw__mean", "gaps__raw__mean"]
_MISS = "(('0x' || substr(md5('{t}|' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

MATRIX_SQL = b.stat_rows_sql() + f""", base AS (
  SELECT entity_id AS row_id, metric || '__' || variant || '__' || stat AS feature, round(value + 1e-9, 6) AS value FROM stat_rows), q AS (
  SELECT row_id, value FROM base WHERE feature = 'quantity__raw__mean'), matrix AS (
  SELECT row_id, feature, value FROM base
  UNION ALL SELECT row_id, 'twin__raw__mean', 2 * value FROM q
  UNION ALL SELECT row_id, 'flat__raw__mean', 7.0 FROM q
  UNION ALL SELECT row_id, 'holes__raw__mean', CASE WHEN {_MISS.format(t='holes')} >= 0.4 THEN value END FROM q
  UNION ALL SELECT row_id, 'gaps__raw__mean', CASE WHEN {_MISS.format(t='gaps')} >= 0.2 THEN round({_MISS.format(t='v')}, 6) END FROM q),
position AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(FEATURES))}) t(feature, position))"""


def matrix(spark, sf):
    return derived_once(spark, f"supplier matrix {sf}", lambda: _matrix(spark, sf))


def _matrix(spark, sf):
    base = b.feature_rows(spark, sf).select(
        F.col("entity_id").alias("row_id"), "feature", F.round(F.col("value") + HALF, 6).alias("value"))
    rid = F.col("row_id")
    planted = F.array(
        F.struct(F.lit("twin__raw__mean").alias("feature"), (2 * F.col("value")).alias("value")),
        F.struct(F.lit("flat__raw__mean").alias("feature"), F.lit(7.0).alias("value")),
        F.struct(F.lit("holes__raw__mean").alias("feature"), F.when(fs.hash_unit(F.lit("holes"), rid) >= 0.4, F.col("value")).alias("value")),
        F.struct(F.lit("gaps__raw__mean").alias("feature"), F.when(fs.hash_unit(F.lit("gaps"), rid) >= 0.2, F.round(fs.hash_unit(F.lit("v"), rid), 6)).alias("value")),
    )
    own = F.array(F.struct("feature", "value"))
    both = F.when(F.col("feature") == "quantity__raw__mean", F.concat(own, planted)).otherwise(own)
    return base.select("row_id", F.explode(both).alias("c")).select("row_id", "c.feature", "c.value")


def _rows(long):
    return long.select("row_id").distinct()


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def r6(*names):
    return [F.round(F.col(n) + HALF, 6).alias(n) for n in names]


_N = "(SELECT count(DISTINCT row_id) FROM {src})"


def chain_sql(train: str, fold: str = "0") -> str:
    """CTEs of the fitted chain over `train`(fold, row_id, feature, value)."""
    return f"""nr AS (SELECT fold, count(DISTINCT row_id) AS n_rows FROM {train} GROUP BY fold), med AS (
  SELECT fold, feature, count(value) AS n, (any_value(n_rows) - count(value)) / any_value(n_rows)::DOUBLE AS missing_frac, quantile_cont(value, 0.5) AS median
  FROM {train} JOIN nr USING (fold) GROUP BY ALL), imp AS (
  SELECT t.fold, row_id, feature, coalesce(value, median) AS value FROM {train} t JOIN med USING (fold, feature)), same AS (
  SELECT fold, feature, max(n) / sum(n)::DOUBLE AS same_share FROM (SELECT fold, feature, value, count(*) AS n FROM imp GROUP BY ALL) GROUP BY ALL), sc AS (
  SELECT fold, feature, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, var_pop(value) AS var FROM imp GROUP BY ALL), st AS (
  SELECT *, CASE WHEN missing_frac > 0.3 THEN 'missingness' WHEN same_share > 0.95 THEN 'near_constant' END AS step
  FROM med JOIN same USING (fold, feature) JOIN sc USING (fold, feature) JOIN position USING (feature)), cand AS (
  SELECT fold, feature, row_number() OVER (PARTITION BY fold ORDER BY format('{{:.10e}}', var)::DOUBLE DESC, position) AS rk FROM st WHERE step IS NULL), cm AS (
  SELECT fold, row_id, rk, value FROM imp JOIN cand USING (fold, feature)), edges AS (
  SELECT a.fold, a.rk AS i, b.rk AS j FROM cm a JOIN cm b ON a.fold = b.fold AND a.row_id = b.row_id AND a.rk < b.rk
  GROUP BY ALL HAVING abs(corr(a.value, b.value)) > 0.95), adj AS (SELECT fold, i, list(j ORDER BY j) AS js FROM edges GROUP BY ALL),
  walk AS (SELECT fold, 0::BIGINT AS step, []::BIGINT[] AS gone, max(rk) AS last FROM cand GROUP BY fold
  UNION ALL SELECT w.fold, w.step + 1, CASE WHEN js IS NULL OR list_contains(gone, w.step + 1) THEN gone
    ELSE list_concat(gone, list_filter(js, lambda x: NOT list_contains(gone, x))) END, last
  FROM walk w LEFT JOIN adj ON adj.fold = w.fold AND adj.i = w.step + 1 WHERE w.step < last), fin AS (
  SELECT fold, unnest(gone) AS rk FROM walk WHERE step = last), link AS (
  SELECT e.fold, e.j AS rk, min(e.i) AS i FROM edges e JOIN fin f ON f.fold = e.fold AND f.rk = e.j
  WHERE NOT EXISTS (SELECT 1 FROM fin g WHERE g.fold = e.fold AND g.rk = e.i) GROUP BY ALL), named AS (
  SELECT l.fold, b.feature, a.feature AS correlated_with FROM link l JOIN cand a ON a.fold = l.fold AND a.rk = l.i JOIN cand b ON b.fold = l.fold AND b.rk = l.rk), state AS (
  SELECT st.fold, st.feature, position, missing_frac, same_share, median, CASE WHEN iqr > 2.3e-15 THEN iqr ELSE 1.0 END AS scale,
    coalesce(step, CASE WHEN correlated_with IS NOT NULL THEN 'correlation' END) AS dropped_by, correlated_with
  FROM st LEFT JOIN named USING (fold, feature))"""


_ONE = "WITH RECURSIVE " + MATRIX_SQL + ", train AS (SELECT 0 AS fold, row_id, feature, value FROM matrix), " + chain_sql("train")


def state(spark, sf):
    long = matrix(spark, sf)
    return long, pp.fit_filters(long, pp.whole_data(_rows(long)), FEATURES)


@query("a20_missing_fraction", "WITH " + MATRIX_SQL + " SELECT feature, round(1 - count(value) / count(*)::DOUBLE + 1e-9, 6) AS missing_frac FROM matrix GROUP BY feature")
def a20(spark, sf):
    long = matrix(spark, sf)
    return pp.column_profile(long.withColumn("fold", F.lit(0)), pp.whole_data(_rows(long)), FEATURES).select("feature", *r6("missing_frac"))


@query("a21_median", "WITH " + MATRIX_SQL + " SELECT feature, round(quantile_cont(value, 0.5) + 1e-9, 6) AS median FROM matrix GROUP BY feature")
def a21(spark, sf):
    long = matrix(spark, sf)
    return pp.column_profile(long.withColumn("fold", F.lit(0)), pp.whole_data(_rows(long)), FEATURES).select("feature", *r6("median"))


@query("a22_top_value_share", "WITH " + MATRIX_SQL + """, n AS (SELECT feature, value, count(*) AS n FROM matrix WHERE value IS NOT NULL GROUP BY ALL)
SELECT feature, round(max(n) / sum(n)::DOUBLE + 1e-9, 6) AS same_share FROM n GROUP BY feature""")
def a22(spark, sf):
    long = matrix(spark, sf)
    return pp.column_profile(long.withColumn("fold", F.lit(0)), pp.whole_data(_rows(long)), FEATURES).select("feature", *r6("same_share"))


@query("a23_variance", "WITH " + MATRIX_SQL + " SELECT feature, round(var_pop(value) + 1e-9, 4) AS variance FROM matrix GROUP BY feature")
def a23(spark, sf):
    return matrix(spark, sf).groupBy("feature").agg(F.round(F.var_pop("value") + HALF, 4).alias("variance"))


_PAIR_SQL = "WITH " + MATRIX_SQL + """, p AS (
  SELECT a.feature AS feature_a, b.feature AS feature_b, pa.position AS i, pb.position AS j,
    CASE WHEN var_pop(a.value) > 1e-13 AND var_pop(b.value) > 1e-13 THEN corr(a.value, b.value) END AS r
  FROM matrix a JOIN position pa ON pa.feature = a.feature JOIN matrix b ON a.row_id = b.row_id JOIN position pb ON pb.feature = b.feature AND pa.position < pb.position
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)"""


@query("a24_pearson_matrix", _PAIR_SQL + " SELECT feature_a, feature_b, round(r + 1e-9, 5) AS r FROM p")
def a24(spark, sf):
    return pp.pearson_matrix(matrix(spark, sf), FEATURES).select("feature_a", "feature_b", F.round(F.col("r") + HALF, 5).alias("r"))


@query("j6_correlated_pairs", _PAIR_SQL + " SELECT feature_a, feature_b FROM p WHERE abs(r) > 0.95")
def j6(spark, sf):
    return pp.pearson_matrix(matrix(spark, sf), FEATURES).where(F.abs("r") > 0.95).select("feature_a", "feature_b")


@query("prep1_missingness", _ONE + " SELECT feature, missing_frac <= 0.3 AS kept FROM state")
def prep1(spark, sf):
    _, s = state(spark, sf)
    return s.select("feature", (F.col("missing_frac") <= 0.3).alias("kept"))


@query("prep2_median_impute", "WITH " + MATRIX_SQL + """, m AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM matrix GROUP BY feature)
SELECT row_id, feature, round(coalesce(value, median) + 1e-9, 6) AS value FROM matrix JOIN m USING (feature)""")
def prep2(spark, sf):
    long = matrix(spark, sf)
    profile = pp.column_profile(long.withColumn("fold", F.lit(0)), pp.whole_data(_rows(long)), FEATURES)
    return long.join(profile.select("feature", "median"), "feature").select(
        "row_id", "feature", F.round(F.coalesce("value", "median") + HALF, 6).alias("value"))


@query("prep3_near_constant", _ONE + " SELECT feature, round(same_share + 1e-9, 6) AS same_share, dropped_by IS NOT DISTINCT FROM 'near_constant' AS dropped FROM state")
def prep3(spark, sf):
    _, s = state(spark, sf)
    return s.select("feature", *r6("same_share"), F.col("dropped_by").eqNullSafe("near_constant").alias("dropped"))


@query("prep4_correlation_filter", _ONE + " SELECT feature, correlated_with FROM state WHERE dropped_by = 'correlation'")
def prep4(spark, sf):
    _, s = state(spark, sf)
    return s.where("dropped_by = 'correlation'").select("feature", "correlated_with")


@query("prep5_robust_scale", _ONE + """ SELECT row_id, feature, round((imp.value - median) / scale + 1e-9, 5) AS value
FROM imp JOIN state USING (fold, feature) WHERE dropped_by IS NULL""")
def prep5(spark, sf):
    long, s = state(spark, sf)
    return pp.apply_filters(long, pp.whole_data(_rows(long)), s).select("row_id", "feature", F.round(F.col("value") + HALF, 5).alias("value"))


@query("prep6_selection_report", _ONE + """ SELECT feature, CASE dropped_by WHEN 'missingness' THEN 'high_missingness (frac=' || format('{:.2f}', missing_frac) || ')'
WHEN 'near_constant' THEN 'near_zero_variance' ELSE 'high_correlation (|r|>0.95)' END AS reason, coalesce(correlated_with, '') AS correlated_with
FROM state WHERE dropped_by IS NOT NULL""")
def prep6(spark, sf):
    return pp.selection_report(state(spark, sf)[1])


@query("s7_selection_report_sink", SQL["prep6_selection_report"])
def s7(spark, sf):
    path = sinks.write_table(prep6(spark, sf), shared_folder(spark), "s7_feature_selection_report")
    return spark.read.parquet(path)


@query("prep7_feature_trace", _ONE + " SELECT feature, position FROM state WHERE dropped_by IS NULL")
def prep7(spark, sf):
    return pp.kept_features(state(spark, sf)[1]).select("feature", "position")


@query("p13_masked_columns", _ONE + " SELECT row_id, feature, matrix.value FROM matrix JOIN state USING (feature) WHERE dropped_by IS NULL")
def p13(spark, sf):
    long, s = state(spark, sf)
    return long.join(pp.kept_features(s).select("feature"), "feature", "left_semi").select("row_id", "feature", "value")


_FOLDS = ("WITH RECURSIVE " + MATRIX_SQL + ", ids AS (SELECT DISTINCT row_id, 0 AS label FROM matrix), " + folds_sql("ids", k=3)
          + ", train AS (SELECT o.fold, m.row_id, feature, value FROM matrix m JOIN folds f USING (row_id), (SELECT unnest(range(3))::INT AS fold) o WHERE o.fold <> f.fold), "
          + chain_sql("train"))


@query("prep8_fold_fit", _FOLDS + " SELECT fold, feature, round(missing_frac + 1e-9, 6) AS missing_frac, round(median + 1e-9, 6) AS median, round(scale + 1e-9, 6) AS scale, dropped_by, correlated_with FROM state")
def prep8(spark, sf):
    long = matrix(spark, sf)
    train = cells_of_folds(sp.shuffled_folds(_rows(long), "row_id", 3, fold="_f"), 3, "_f")
    s = pp.fit_filters(long, train, FEATURES)
    return s.select("fold", "feature", *r6("missing_frac", "median", "scale"), "dropped_by", "correlated_with")
