"""Queries of the scan, projection, join and per-entity statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.catalog import bindings as b
from folioscope.functions import scalars as fs
from folioscope.operators import stats as st
from folioscope.plans.features import extract_features, select_features, entity_selection
from folioscope.session import shared_folder
from folioscope.sources import sinks, tables

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# Averages of decimals can sit exactly between two rounded values; a shift far below the shown
# precision, the same on both sides of a check, makes them round alike.
HALF = 1e-9


def r6(*names):
    return [F.round(F.col(n) + HALF, 6).alias(n) for n in names]


def rsql(names):
    return ", ".join(f"round({n} + {HALF}, 6) AS {n}" for n in names)


# ---- scans and sinks -------------------------------------------------------------------

@query("s1_entity_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s1(spark, sf):
    root = shared_folder(spark) + "/s1_entities"
    src = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    src.write.mode("overwrite").option("header", True).csv(root)
    schema = T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
        T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType()),
    ])
    return tables.read_entities_csv(spark, root, schema)


@query("s2_fleet_scan", "SELECT CAST(user_id AS VARCHAR) AS entity_id, value, (event_type = 'error') AS failed FROM events")
def s2(spark, sf):
    # One directory per entity, as frame logs arrive; the key comes back from the path.
    root = shared_folder(spark) + "/s2_logs"
    ev = spark.read.parquet(f"{sf}/events.parquet")
    (ev.select(
        F.col("user_id").cast("string").alias("entity_dir"), F.col("event_id").alias("frame_no"),
        "value", (F.col("event_type") == "error").alias("failed"), F.lit(1).alias("segment_id"))
     .repartition("entity_dir")
     # Tasks move their own directories; version 1 lets the driver move those of all entities.
     .write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy("entity_dir").option("header", True).csv(root))
    schema = T.StructType([
        T.StructField("frame_no", T.LongType()), T.StructField("value", T.DoubleType()),
        T.StructField("failed", T.BooleanType()), T.StructField("segment_id", T.IntegerType()),
    ])
    logs = tables.read_frame_logs(spark, root, schema, "*.csv")
    return logs.select(F.regexp_replace("entity_id", "^entity_dir=", "").alias("entity_id"), "value", "failed")


@query("s3_optional_variant", "WITH " + b.FRAMES_SQL + """
SELECT entity_id, 'raw' AS variant, l_quantity, l_tax FROM frames
UNION ALL SELECT entity_id, 'norm', q_norm, NULL FROM frames""")
def s3(spark, sf):
    f = b.frames(spark, sf)
    raw = f.select("entity_id", "l_quantity", "l_tax")
    norm = f.select("entity_id", F.col("q_norm").alias("l_quantity"))
    return tables.with_variants(raw, norm).select("entity_id", "variant", "l_quantity", "l_tax")


@query("s4_pruned_scan", "SELECT l_suppkey AS entity_id, l_quantity, l_discount FROM lineitem")
def s4(spark, sf):
    li = tables.read_table(spark, sf, "lineitem")
    tagged = li.withColumn("segment_id", F.col("l_linenumber"))
    numeric, _ = tables.metric_columns(
        tagged.select("segment_id", "l_quantity", "l_discount"), ids=())
    return tagged.select(F.col("l_suppkey").alias("entity_id"), *numeric)


@query("s5_skipped_entities", """SELECT c_custkey AS entity_id, 'no frames' AS reason FROM customer
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def s5(spark, sf):
    listed = tables.read_table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("entity_id"))
    return tables.missing_sources(listed, b.event_frames(spark, sf), "entity_id").withColumn("reason", F.lit("no frames"))


@query("s6_feature_matrix_sink", "WITH " + b.stat_rows_sql() + ", named AS (SELECT entity_id, metric || '__' || variant || '__' || stat AS feature, round(value + 1e-9, 5) AS value FROM stat_rows) SELECT entity_id, "
       + ", ".join(f"max(CASE WHEN feature = '{f}' THEN value END) AS \"{f}\"" for f in b.FEATURES)
       + " FROM named GROUP BY entity_id")
def s6(spark, sf):
    rows = b.feature_rows(spark, sf)
    rows = rows.withColumn("value", F.round(F.col("value") + HALF, 5))
    path = sinks.write_table(sinks.wide_matrix(rows, ["entity_id"], b.FEATURES), shared_folder(spark), "s6_feature_matrix")
    return spark.read.parquet(path)


# ---- projections and predicates --------------------------------------------------------

@query("p1_allowed_entities", "WITH " + b.ENTITIES_SQL + """
SELECT uuid, diagnosis FROM entities WHERE results_path IS NOT NULL AND diagnosis IN ('ASIA', 'EUROPE')""")
def p1(spark, sf):
    return entity_selection(b.entities(spark, sf), "results_path", "diagnosis", ["ASIA", "EUROPE"]).select("uuid", "diagnosis")


@query("p2_first_entities", "WITH " + b.ENTITIES_SQL + """
SELECT uuid, diagnosis FROM entities WHERE results_path IS NOT NULL AND diagnosis IN ('ASIA', 'EUROPE') ORDER BY uuid LIMIT 5""")
def p2(spark, sf):
    return entity_selection(
        b.entities(spark, sf), "results_path", "diagnosis", ["ASIA", "EUROPE"], order="uuid", first=5
    ).select("uuid", "diagnosis")


@query("p3_clinical_columns", "WITH " + b.ENTITIES_SQL + " SELECT uuid, diagnosis, gender, round(age, 6) AS age FROM entities")
def p3(spark, sf):
    from folioscope.plans.features import present_columns
    ent = b.entities(spark, sf)
    want = present_columns(ent, ["uuid", "diagnosis", "gender", "module"], ["age", "diagnosis", "absent"])
    return ent.select(*want).withColumn("age", F.round("age", 6))


@query("p4_feature_selector", "WITH " + b.LONG_SQL + """, stats(stat) AS (VALUES ('median'), ('cv'))
SELECT DISTINCT metric || '__' || variant || '__' || stat AS feature, variant, stat
FROM long, stats WHERE variant = 'norm' AND stat = 'median'""")
def p4(spark, sf):
    rows = b.feature_rows(spark, sf)
    return select_features(rows, variant="norm", stat="median").select("feature", "variant", "stat").distinct()


@query("p5_encode_gender", "WITH " + b.ENTITIES_SQL + """
SELECT uuid, gender, CASE WHEN gender IN ('Male', 'male') THEN 1.0::DOUBLE WHEN gender IN ('Female', 'female') THEN 0.0::DOUBLE END AS code FROM entities""")
def p5(spark, sf):
    return b.entities(spark, sf).select("uuid", "gender", fs.encode_gender("gender").alias("code"))


@query("p6_matrix_assembly", "WITH " + b.ENTITIES_SQL + ", " + b.stat_rows_sql() + """
, f AS (SELECT entity_id, metric || '__' || variant || '__' || stat AS feature, value FROM stat_rows)
SELECT uuid AS entity_id, 'age' AS feature, round(age, 5) AS value, 0 AS block FROM entities
UNION ALL SELECT uuid, 'gender', CASE WHEN gender IN ('Male', 'male') THEN 1.0 WHEN gender IN ('Female', 'female') THEN 0.0 END, 1 FROM entities
UNION ALL SELECT entity_id, feature, round(value + 1e-9, 5), 2 FROM f JOIN entities ON uuid = entity_id""")
def p6(spark, sf):
    from folioscope.plans.features import assemble_rows
    rows = b.feature_rows(spark, sf)
    meta = b.entities(spark, sf).withColumnRenamed("uuid", "entity_id")
    out = assemble_rows(rows, meta, age="age", gender="gender")
    return out.withColumn("value", F.round(F.col("value") + HALF, 5))


@query("p11_minimum_valid", "WITH " + b.stats_sql(b.EVENTS_LONG_SQL) + f"""
SELECT entity_id, n, {rsql(['mean', 'median', 'std'])} FROM stats""")
def p11(spark, sf):
    return st.frame_statistics(b.event_frames(spark, sf), "entity_id", {("value", "raw"): F.col("value")}).select("entity_id", "n", *r6("mean", "median", "std"))


@query("p12_clip", """SELECT l_orderkey, l_linenumber,
CASE WHEN l_linestatus <> 'O' THEN greatest(0.01, least(0.05, l_tax)) END AS tax_clipped,
greatest(10.0, least(40.0, l_quantity)) AS quantity_clipped FROM lineitem""")
def p12(spark, sf):
    li = tables.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_linestatus", "l_tax", "l_quantity"])
    tax = F.when(F.col("l_linestatus") != "O", F.col("l_tax"))
    return li.select(
        "l_orderkey", "l_linenumber",
        fs.clip(tax, F.lit(0.01), F.lit(0.05)).alias("tax_clipped"),
        fs.clip(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("quantity_clipped"))


# ---- joins -----------------------------------------------------------------------------

@query("j1_features_with_metadata", "WITH " + b.ENTITIES_SQL + ", " + b.stat_rows_sql() + """
SELECT entity_id, diagnosis, gender, metric || '__' || variant || '__' || stat AS feature, round(value + 1e-9, 5) AS value
FROM stat_rows JOIN entities ON uuid = entity_id WHERE results_path IS NOT NULL""")
def j1(spark, sf):
    ent = b.entities(spark, sf).where("results_path IS NOT NULL").withColumnRenamed("uuid", "entity_id")
    rows = b.feature_rows(spark, sf)
    return rows.join(ent, "entity_id").select(
        "entity_id", "diagnosis", "gender", "feature", F.round(F.col("value") + HALF, 5).alias("value"))


@query("j2_raw_beside_norm", "WITH " + b.stats_sql() + """
SELECT entity_id, metric, round(max(CASE WHEN variant = 'raw' THEN median END), 6) AS raw_median,
round(max(CASE WHEN variant = 'norm' THEN median END), 6) AS norm_median FROM stats GROUP BY ALL""")
def j2(spark, sf):
    s = b.frame_statistics(spark, sf)
    wide = sinks.wide_matrix(s, ["entity_id", "metric"], ["raw", "norm"], "variant", "median")
    return wide.select("entity_id", "metric", F.round("raw", 6).alias("raw_median"), F.round("norm", 6).alias("norm_median"))


@query("j11_entities_without_frames", """SELECT c_custkey AS entity_id, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def j11(spark, sf):
    listed = tables.read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "entity_id")
    return tables.missing_sources(listed, b.event_frames(spark, sf), "entity_id")


# ---- per-entity statistics -------------------------------------------------------------

_KEYS = "entity_id, metric, variant"


def _stat_query(name, columns, digits=6):
    sql = "WITH " + b.stats_sql() + f" SELECT {_KEYS}, " + ", ".join(
        f"round({c} + {HALF}, {digits}) AS {c}" for c in columns) + " FROM stats"

    def run(spark, sf):
        s = b.frame_statistics(spark, sf)
        return s.select("entity_id", "metric", "variant", *[F.round(F.col(c) + HALF, digits).alias(c) for c in columns])

    query(name, sql)(run)


_stat_query("a1_mean", ["mean"])
_stat_query("a2_quantiles", ["q10", "q25", "median", "q75", "q90"])
_stat_query("a3_iqr", ["iqr"])
_stat_query("a5_std_clipped", ["std"])
_stat_query("a6_cv_guarded", ["cv"])
_stat_query("a7_skewness", ["skewness"])
_stat_query("a8_kurtosis", ["kurtosis"])


@query("a4_tukey_fences", "WITH " + b.stats_sql() + f" SELECT {_KEYS}, {rsql(['lo', 'hi'])} FROM fence")
def a4(spark, sf):
    located = st.location_statistics(b.long_frames(spark, sf), ["entity_id", "metric", "variant"], within=["metric", "variant"])
    return located.groups.select("entity_id", "metric", "variant", *r6("lo", "hi"))


# A metric whose middle half is one value: the clipped group is constant.
_FLAT_SQL = """long AS (SELECT l_suppkey AS entity_id, 'flat' AS metric, 'raw' AS variant,
CASE WHEN l_quantity <= 40 THEN 7.0 ELSE l_quantity END AS value FROM lineitem)"""


@query("a9_constant_group", "WITH " + b.stats_sql(_FLAT_SQL) + """ SELECT entity_id, round(mean + 1e-9, 6) AS mean, iqr, std, cv,
CASE WHEN std > 0 THEN skewness END AS skewness, CASE WHEN std > 0 THEN kurtosis END AS kurtosis FROM stats""")
def a9(spark, sf):
    li = tables.read_table(spark, sf, "lineitem", ["l_suppkey", "l_quantity"])
    flat = li.select(
        F.col("l_suppkey").alias("entity_id"),
        F.when(F.col("l_quantity") <= 40, 7.0).otherwise(F.col("l_quantity")).alias("value"))
    return st.frame_statistics(flat, "entity_id", {("flat", "raw"): F.col("value")}).select("entity_id", F.round(F.col("mean") + HALF, 6).alias("mean"), "iqr", "std", "cv", "skewness", "kurtosis")


@query("a10_boolean_share", """SELECT user_id AS entity_id, 'failed' AS metric,
CASE WHEN count(*) >= 50 THEN round(avg((event_type = 'error')::INT) + 1e-9, 6) END AS mean FROM events GROUP BY user_id""")
def a10(spark, sf):
    ev = tables.read_table(spark, sf, "events", ["user_id", "event_type"]).select(
        F.col("user_id").alias("entity_id"), F.lit("failed").alias("metric"), F.lit("raw").alias("variant"),
        (F.col("event_type") == "error").alias("value"))
    return st.boolean_statistics(ev).select("entity_id", "metric", *r6("mean"))


@query("a11_full_extractor", "WITH " + b.stat_rows_sql() + """
SELECT entity_id, metric || '__' || variant || '__' || stat AS feature, round(value + 1e-9, 5) AS value FROM stat_rows""")
def a11(spark, sf):
    return b.feature_rows(spark, sf).select(
        "entity_id", "feature", F.round(F.col("value") + HALF, 5).alias("value"))


@query("a11_full_extractor_hot_path", "WITH " + b.stats_sql() + f"""
SELECT {_KEYS}, n, {rsql(b.STATS)} FROM stats""")
def a11_hot(spark, sf):
    # The same statistics through the path taken by entities too long for one task.
    return st.sharded_statistics(b.long_frames(spark, sf), ["entity_id", "metric", "variant"]).select(
        "entity_id", "metric", "variant", "n", *r6(*b.STATS))


@query("a12_sketch_quantiles")
def a12(spark, sf):
    return st.approximate_quantiles(b.long_frames(spark, sf), ["entity_id", "metric", "variant"])


@query("g1_feature_matrix", "WITH " + b.ENTITIES_SQL + ", " + b.stat_rows_sql() + """
SELECT entity_id, diagnosis, metric, variant, stat, round(value + 1e-9, 5) AS value
FROM stat_rows JOIN entities ON uuid = entity_id WHERE results_path IS NOT NULL""")
def g1(spark, sf):
    ent = b.entities(spark, sf).withColumnRenamed("uuid", "entity_id")
    out = extract_features(
        b.frames(spark, sf), entity_selection(ent, "results_path", "diagnosis"), "entity_id",
        b.numeric_cells(), b.boolean_cells())
    return out.features.join(out.entities.select("entity_id", "diagnosis"), "entity_id").select(
        "entity_id", "diagnosis", "metric", "variant", "stat", F.round(F.col("value") + HALF, 5).alias("value"))


# ---- scalar functions ------------------------------------------------------------------

@query("f1_path_stem", r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages""")
def f1(spark, sf):
    return tables.read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", fs.path_stem("url").alias("stem"))


@query("f2_feature_names", "WITH " + b.stat_rows_sql() + """
SELECT DISTINCT metric || '__' || variant || '__' || stat AS feature, metric, variant, stat FROM stat_rows""")
def f2(spark, sf):
    names = b.feature_rows(spark, sf).select("feature").distinct()
    return names.select("feature", fs.feature_name_parts("feature").alias("p")).select("feature", "p.*")


@query("f3_shorten", """SELECT page_id, CASE WHEN length(url) > 45 THEN substr(url, 1, 45) || '…' ELSE url END AS short FROM pages""")
def f3(spark, sf):
    return tables.read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", fs.shorten("url").alias("short"))


@query("f4_file_safe", """SELECT page_id, substr(replace(replace(url, '/', '_'), ' ', '_'), 1, 40) AS safe FROM pages""")
def f4(spark, sf):
    return tables.read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", fs.file_safe("url").alias("safe"))
