import pytest

from folioscope.functions.scalars import correlation_p
from folioscope.operators import compare, metrics


def preds(spark, rows):
    return spark.createDataFrame(rows, "fold int, model string, row_id bigint, y_true int, y_pred int, y_prob double")


def test_tied_scores_and_one_class(spark):
    rows = [(0, "m", i, i % 2, 1, 0.5) for i in range(20)] + [(1, "m", i, 1, 1, i / 20) for i in range(20)]
    out = {r["fold"]: r["auc_roc"] for r in metrics.auc(preds(spark, rows)).collect()}
    assert out == {0: 0.5, 1: None}
    curve = metrics.roc_points(metrics.score_steps(preds(spark, rows))).collect()
    assert {r["fold"] for r in curve} == {0}


def test_curve_drops_collinear_points(spark):
    rows = [(0, "m", i, int(i < 5), 1, 1 - i / 10) for i in range(10)]
    pts = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(metrics.score_steps(preds(spark, rows))).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.2), (0.0, 1.0), (1.0, 1.0)]


def test_wilcoxon_exact(spark):
    rows = [(f, m, v) for f in range(5) for m, v in (("a", 0.9 + f / 100), ("b", 0.5), ("c", 0.5))]
    cv = spark.createDataFrame(rows, "fold int, model string, auc double")
    p = {(r["m1"], r["m2"]): r["p"] for r in compare.wilcoxon(compare.model_pairs(cv, "auc")).collect()}
    assert p[("a", "b")] == pytest.approx(0.0625)
    assert p[("b", "c")] == 1.0
    table = compare.comparison_table(cv, "auc", ["a", "b", "c"]).collect()
    assert table[0]["model"] == "a" and table[0]["p_vs_b_bonf"] == pytest.approx(0.1875)


def test_correlation_p_table():
    # Critical values of r at 5 %, two-sided.
    for n, r in ((5, 0.878), (10, 0.632), (30, 0.361), (102, 0.195)):
        assert correlation_p(r, n) == pytest.approx(0.05, abs=6e-4)
    assert correlation_p(0.0, 10) == pytest.approx(1.0)
    assert correlation_p(1.0, 10) == 0.0


def test_residual_maximum_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(0, "m", i, 0.0, float(i)) for i in range(21)], "fold int, model string, row_id bigint, y_true double, y_pred double")
    bins = {r["bin"]: r["n"] for r in metrics.residual_histogram(df).collect()}
    assert sum(bins.values()) == 21 and max(bins) == 20 and bins[20] == 2


def test_signed_rank_is_exact_beyond_twelve_folds(spark):
    import itertools
    import random

    from folioscope.operators import compare

    rng = random.Random(2)
    for folds in (13, 16):
        gaps = [0.01 * (i + 1) for i in range(folds)] if folds == 13 else [rng.choice([-3, -1, 1, 2, 2, 4]) / 100 for _ in range(folds)]
        cv = spark.createDataFrame([(i, m, 0.5 + (g if m == "b" else 0.0)) for i, g in enumerate(gaps) for m in "ab"], "fold int, model string, auc double")
        size = sorted(abs(round(g, 12)) for g in gaps)
        ranks = [size.index(abs(round(g, 12))) + 1 + (size.count(abs(round(g, 12))) - 1) / 2 for g in gaps]
        plus = sum(r for r, g in zip(ranks, gaps) if g < 0)
        far = max(plus, sum(ranks) - plus)
        hits = sum(sum(r for r, s in zip(ranks, signs) if s) >= far for signs in itertools.product((0, 1), repeat=folds))
        got = compare.wilcoxon(compare.model_pairs(cv, "auc")).first()["p"]
        assert abs(got - min(1.0, 2 * hits / 2 ** folds)) < 1e-12


def test_rows_are_dealt_before_they_become_one_per_class(spark):
    rows = [(0, "m", i, i % 3, 0, 0.5, [0.2 + (i % 3 == c) / 2 for c in range(3)]) for i in range(30)]
    pred = spark.createDataFrame(rows, "fold int, model string, row_id bigint, y_true int, y_pred int, y_prob double, probs array<double>")
    out = metrics.auc_one_vs_rest(pred.coalesce(1), "probs", 3)
    assert out.first()["auc_roc"] == 1.0
    assert "REBALANCE" in out._jdf.queryExecution().executedPlan().toString()
