import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import stats as st

GROUPS = {
    "constant": [5.0] * 60,
    "zero": [0.0] * 60,
    "short": [float(i) for i in range(49)],
    "edge": [float(i) for i in range(50)],
    "burst": [i / 97 for i in range(97)] + [1000.0] * 3,
    "signed": [float(i) for i in range(-40, 41)],
    "flat": [1.0] * 80 + [float(i) for i in range(20)],
    "missing": [None] * 60,
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(g, v) for g, vs in GROUPS.items() for v in vs]
    return spark.createDataFrame(rows, "entity_id string, value double")


@pytest.fixture(scope="module", params=["grouped", "sharded", "mixed"])
def table(request, frames):
    cells = {("v", "raw"): F.col("value")}
    if request.param == "sharded":
        long = frames.select("entity_id", F.lit("v").alias("metric"), F.lit("raw").alias("variant"), "value")
        df = st.sharded_statistics(long, ["entity_id", "metric", "variant"])
    else:
        df = st.frame_statistics(frames, "entity_id", cells, hot_rows=70 if request.param == "mixed" else 10**6)
    return {r["entity_id"]: r for r in df.collect()}


def test_all_groups_present(table):
    assert set(table) == set(GROUPS)


def test_constant_groups(table):
    c, z = table["constant"], table["zero"]
    assert (c["std"], c["iqr"], c["cv"], c["skewness"], c["kurtosis"]) == (0.0, 0.0, 0.0, None, None)
    assert z["std"] == 0.0 and z["cv"] is None
    assert table["flat"]["iqr"] == 0.0 and table["flat"]["std"] == 0.0


def test_gate(table):
    assert table["short"]["mean"] is None and table["short"]["q10"] is None
    assert table["edge"]["mean"] == pytest.approx(24.5)
    assert table["missing"]["n"] == 0 and table["missing"]["median"] is None


def test_clipping_and_guard(table):
    x = np.array(GROUPS["burst"])
    q25, q75 = np.percentile(x, [25, 75])
    c = np.clip(x, q25 - 3 * (q75 - q25), q75 + 3 * (q75 - q25))
    r = table["burst"]
    assert r["mean"] == pytest.approx(x.mean())
    assert r["std"] == pytest.approx(c.std(ddof=1), rel=1e-9)
    n, d = len(c), c - c.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert r["skewness"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-9)
    assert r["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), rel=1e-9)
    assert table["signed"]["cv"] is None


def test_quantiles_match_numpy(spark):
    from folioscope.operators.ordered import exact_quantiles

    rng = np.random.default_rng(3)
    data = {g: np.round(rng.gamma(2, 3, size), 1) for g, size in (("a", 1), ("b", 2), ("c", 501), ("d", 1000))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    out = exact_quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()
    for r in out:
        assert [r["lo"], r["mid"], r["hi"]] == pytest.approx(list(np.percentile(data[r["g"]], [10, 50, 90])))


def test_long_groups_fall_into_value_ranges(spark, monkeypatch):
    from folioscope.operators import ordered

    monkeypatch.setattr(ordered, "CELL_ROWS", 100)
    rng = np.random.default_rng(5)
    data = {g: np.round(rng.gamma(2, 3, size), 1) for g, size in (("short", 60), ("long", 4000), ("mid", 150))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("short", None)] * 7, "g string, v double")
    cells = ordered.value_cells(df, ["g"], "v", keep_missing=True)
    shards = {r["g"]: r["n"] for r in cells.groupBy("g").agg(F.countDistinct("shard").alias("n")).collect()}
    assert shards["short"] == 1 and shards["long"] > 20
    out = {r["g"]: r for r in st.location_statistics(df, ["g"], "v").groups.collect()}
    for g, values in data.items():
        assert out[g]["n"] == len(values) and out[g]["mean"] == pytest.approx(values.mean())
        assert [out[g][q] for q in st.QUANTILES] == pytest.approx(list(np.percentile(values, [10, 25, 50, 75, 90])))


def test_values_of_short_groups_move_once(spark):
    # They moved by value to be counted and once more by range for the running sums.
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(50)], "g string, v double")
    plan = st.location_statistics(df, ["g"], "v").groups._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "v#" in line.split("hashpartitioning")[1].split("ENSURE")[0].split("REPARTITION")[0]]
    assert not moved


def test_entity_statistics_need_no_join_and_no_percentile(spark, frames):
    out = st.grouped_statistics(frames, "entity_id", {("v", "raw"): F.col("value"), ("w", "raw"): F.col("value") * 2})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_rows_of_the_hot_path_move_once_under_short_keys(spark):
    long = spark.range(400).select(
        F.concat(F.lit("e"), F.col("id") % 4).alias("entity_id"), F.explode(F.array(F.lit("speed"), F.lit("gap"))).alias("metric"),
        F.lit("raw").alias("variant"), F.when(F.col("id") % 5 > 0, F.col("id") * F.col("id") / 7.0).alias("value"))
    keys = ["entity_id", "metric", "variant"]
    out = st.sharded_statistics(long, keys, min_valid=5)
    rows = {(r["entity_id"], r["metric"], r["variant"]): r for r in out.collect()}
    assert len(rows) == 8 and all(r["n"] == 80 and r["kurtosis"] is not None for r in rows.values())
    want = {(r["entity_id"], r["metric"], r["variant"]): r["mean"] for r in long.groupBy(*keys).agg(F.avg("value").alias("mean")).collect()}
    assert all(rows[k]["mean"] == pytest.approx(want[k]) for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "Reused" not in line]
    assert len(moved) == 1 and "metric" not in moved[0]
