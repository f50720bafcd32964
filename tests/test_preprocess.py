import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import preprocess as pp
from folioscope.operators import splits as sp
from folioscope.operators import foldsums
from folioscope.operators.foldsums import TrainingCells, cells_of_folds, cells_of_nested


def long_of(spark, columns):
    rows = [(i, name, None if v is None else float(v)) for name, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "row_id bigint, feature string, value double")


def fit(spark, columns, rows=None):
    long = long_of(spark, columns)
    rows = rows if rows is not None else pp.whole_data(long.select("row_id").distinct())
    return {(r["fold"], r["feature"]): r for r in pp.fit_filters(long, rows, list(columns)).collect()}


def test_thresholds_and_scaling(spark):
    rng = np.random.default_rng(0)
    n = 100
    base = rng.normal(size=n)
    columns = {
        "edge_missing": [None] * 30 + list(rng.normal(size=70)),
        "over_missing": [None] * 31 + list(rng.normal(size=69)),
        "edge_same": [1.0] * 95 + list(rng.normal(size=5)),
        "over_same": [1.0] * 96 + list(rng.normal(size=4)),
        "empty": [None] * n,
        "base": base,
    }
    s = fit(spark, columns)
    assert s[0, "edge_missing"]["dropped_by"] is None
    assert s[0, "over_missing"]["dropped_by"] == "missingness"
    assert s[0, "edge_same"]["dropped_by"] is None
    assert s[0, "over_same"]["dropped_by"] == "near_constant"
    assert s[0, "empty"]["dropped_by"] == "missingness"
    x = np.array([np.nan if v is None else v for v in columns["edge_missing"]])
    med = np.nanmedian(x)
    x = np.where(np.isnan(x), med, x)
    assert s[0, "edge_missing"]["median"] == pytest.approx(med)
    assert s[0, "edge_missing"]["scale"] == pytest.approx(np.subtract(*np.percentile(x, [75, 25])))
    assert s[0, "edge_same"]["scale"] == 1.0


def test_correlation_chain_keeps_the_far_end(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(size=400)
    a = 3 * (b + 0.25 * rng.normal(size=400))
    c = 0.5 * (b + 0.25 * rng.normal(size=400))
    assert abs(np.corrcoef(a, b)[0, 1]) > 0.95 and abs(np.corrcoef(b, c)[0, 1]) > 0.95
    assert abs(np.corrcoef(a, c)[0, 1]) < 0.95
    s = fit(spark, {"c": c, "b": b, "a": a})
    assert s[0, "b"]["dropped_by"] == "correlation" and s[0, "b"]["correlated_with"] == "a"
    assert s[0, "a"]["dropped_by"] is None and s[0, "c"]["dropped_by"] is None


def test_training_state_ignores_test_rows(spark):
    rng = np.random.default_rng(2)
    columns = {"u": rng.normal(size=60), "v": rng.normal(size=60)}
    ids = spark.range(60).select(F.col("id").alias("row_id"))
    folds = sp.shuffled_folds(ids, "row_id", 3, fold="f")
    train = sp.training_rows(folds, 3, "f", "fold")
    before = fit(spark, columns, train)
    held = [r["row_id"] for r in folds.where("f = 1").collect()]
    changed = {k: np.array(v) for k, v in columns.items()}
    for v in changed.values():
        v[held] = 1e6
    after = fit(spark, changed, train)
    for name in columns:
        assert before[1, name] == after[1, name]
        assert before[0, name] != after[0, name]


def test_folds_partition_rows(spark):
    rows = spark.range(203).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("label"))
    out = sp.stratified_folds(rows, "row_id", "label", 5).collect()
    assert len(out) == 203 and len({r["row_id"] for r in out}) == 203
    for label in "ab":
        sizes = [sum(r["fold"] == f and r["label"] == label for r in out) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def columns_with_holes(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    holes = [None if rng.random() < 0.2 else float(v) for v in base + 0.01 * rng.normal(size=n)]
    return {"base": base, "near": 2 * base + 1e-3 * rng.normal(size=n), "holes": holes, "few": rng.integers(0, 3, n).astype(float),
            "flat": np.full(n, 4.0), "other": rng.normal(size=n)}


def plain_fit(columns, rows):
    """The chain over one training set, by numpy."""
    out, kept = {}, []
    for at, (name, values) in enumerate(columns.items()):
        x = np.array([np.nan if values[r] is None else values[r] for r in rows], float)
        missing, median = np.isnan(x).mean(), np.nanmedian(x)
        x = np.where(np.isnan(x), median, x)
        iqr = np.subtract(*np.percentile(x, [75, 25]))
        same = np.unique(x, return_counts=True)[1].max() / len(x)
        step = "missingness" if missing > 0.3 else "near_constant" if same > 0.95 else None
        out[name] = [missing, same, median, iqr if iqr > 1e-14 else 1.0, step, None]
        if step is None:
            kept.append((-x.var(), at, name, x))
    alive = []
    for _, _, name, x in sorted(kept, key=lambda k: k[:2]):
        partner = next((n for n, y in alive if abs(np.corrcoef(x, y)[0, 1]) > 0.95), None)
        if partner:
            out[name][4:] = ["correlation", partner]
        else:
            alive.append((name, x))
    return out


@pytest.mark.parametrize("block,ranges", [(256, 1 << 17), (2, 13)])
def test_nested_training_sets_are_sums_of_cells(spark, monkeypatch, block, ranges):
    monkeypatch.setattr(foldsums, "BLOCK", block)
    monkeypatch.setattr(foldsums, "RANGE_ROWS", ranges)
    n, columns = 90, columns_with_holes(90)
    ids = spark.range(n).select(F.col("id").alias("row_id"))
    train = sp.training_rows(sp.shuffled_folds(ids, "row_id", 3, fold="_f"), 3, "_f", "o")
    inner = sp.shuffled_folds(train, "row_id", 2, 42, "i", ["o"]).cache()
    cells = cells_of_nested(inner, 3, 2)
    got = {(r["fold"], r["feature"]): r for r in pp.fit_filters(long_of(spark, columns), cells, list(columns)).collect()}
    assert len(got) == 9 * len(columns)
    place = [(r["row_id"], r["o"], r["i"]) for r in inner.collect()]
    for fold in range(9):
        o, s = divmod(fold, 3)
        rows = sorted(r for r, oo, i in place if oo == o and (s == 0 or i != s - 1))
        for name, (missing, same, median, scale, step, partner) in plain_fit(columns, rows).items():
            r = got[fold, name]
            assert (r["dropped_by"], r["correlated_with"]) == (step, partner)
            assert [r["missing_frac"], r["same_share"], r["median"], r["scale"]] == pytest.approx([missing, same, median, scale])


def test_cells_give_what_training_rows_give(spark):
    columns = columns_with_holes(60)
    ids = spark.range(60).select(F.col("id").alias("row_id"))
    folds = sp.shuffled_folds(ids, "row_id", 3, fold="f")
    by_cells = fit(spark, columns, cells_of_folds(folds, 3, "f"))
    by_rows = fit(spark, columns, sp.training_rows(folds, 3, "f", "fold"))
    assert by_cells.keys() == by_rows.keys()
    for k, r in by_cells.items():
        assert r["dropped_by"] == by_rows[k]["dropped_by"] and r["median"] == by_rows[k]["median"] and r["scale"] == by_rows[k]["scale"]


def test_products_merge_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(foldsums, "BLOCK", 3)
    monkeypatch.setattr(foldsums, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 7))
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id bigint, x array<double>")
    cells = TrainingCells(vectors.select("row_id", (F.col("row_id") % 2).cast("int").alias("cell")), ((0, 0), (0, 1)))
    held = foldsums.marked(vectors, cells, 7)
    rows = foldsums.block_products(held, [0.0] * 7).collect()
    assert len(rows) == 2 * 6
    for r in rows:
        part = x[r["cell"]::2]
        uu = foldsums.block_parts([r["data"]], r["i"], r["j"], 7, 3)[0]
        assert np.allclose(uu, (part.T @ part)[3 * r["i"]:3 * r["i"] + 3, 3 * r["j"]:3 * r["j"] + 3])
