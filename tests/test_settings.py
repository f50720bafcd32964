import pytest

from folioscope.plans.settings import RunSettings, from_mapping, validate


def test_defaults():
    s = from_mapping({})
    assert s == RunSettings() and s.classification.use_smote and s.methods == ["pca", "umap"]


def test_overrides():
    s = from_mapping({
        "targets": ["t1", "t2"], "global": {"random_state": 7, "corr_threshold": 0.9},
        "dimreduce": {"methods": []},
        "classification": {"smote": False, "n_iter": 200, "models": {
            "rf": {"enabled": False}, "lgbm": {"enabled": True, "params": {"num_leaves": 15}}}},
        "regression": {"enabled": False}, "explain": {"targets": ["t1"]},
    })
    assert s.seed == 7 and s.corr_threshold == 0.9 and s.skip_reduction
    assert s.classification.model_filter == ["lgbm"] and s.classification.fixed_params == {"lgbm": {"num_leaves": 15}}
    assert not s.classification.use_smote and s.classification.n_iter == 200 and not s.regression.enabled
    assert s.targets == ["t1", "t2"] and s.explain_targets == ["t1"]


@pytest.mark.parametrize("bad", [
    {"nope": 1}, {"global": {"x": 1}}, {"dimreduce": {"methods": ["tsne"]}}, {"dimreduce": {"umap": {"k": 1}}},
    {"classification": {"models": {"ridge": {}}}}, {"regression": {"models": {"rf": {"on": True}}}},
    {"targets": "x"}, {"explain": {"targets": [1]}}, {"classification": {"models": {"rf": {"enabled": False}}}},
])
def test_rejected(bad):
    with pytest.raises(ValueError):
        from_mapping(bad)


def test_valid_passes():
    validate({"global": {"n_jobs": 4}, "classification": {"enabled": True}})
