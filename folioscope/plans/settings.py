"""Run settings as a plain object. Values arrive as Python mappings; parsing files is the
caller's business."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from folioscope.operators.models import CLASSIFICATION_GRIDS, REGRESSION_GRIDS

# Accepted keys per section and default targets.
SECTIONS = {
    "global": {"n_jobs", "random_state", "corr_threshold"},
    "dimreduce": {"methods", "umap"},
    "classification": {"enabled", "n_outer_folds", "n_inner_folds", "n_iter", "models", "smote"},
    "regression": {"enabled", "n_outer_folds", "n_inner_folds", "n_iter", "models", "smote"},
    "explain": {"enabled", "targets"},
}
UMAP_KEYS = {"n_neighbors", "min_dist"}
MODEL_KEYS = {"enabled", "params"}
METHODS = {"pca", "umap"}
DEFAULT_TARGETS = ["diagnosis", "ADOS_2_TOTAL"]


@dataclass(frozen=True)
class TaskSettings:
    enabled: bool = True
    n_outer: int = 5
    n_inner: int = 3
    n_iter: int = 50
    model_filter: list[str] | None = None
    fixed_params: dict[str, dict] = field(default_factory=dict)
    use_smote: bool = True


@dataclass(frozen=True)
class RunSettings:
    parallelism: int = 4
    seed: int = 42
    corr_threshold: float = 0.95
    methods: list[str] = field(default_factory=lambda: ["pca", "umap"])
    skip_reduction: bool = False
    n_neighbors: int = 15
    min_dist: float = 0.1
    classification: TaskSettings = TaskSettings()
    regression: TaskSettings = TaskSettings()
    skip_explain: bool = False
    targets: list[str] = field(default_factory=lambda: list(DEFAULT_TARGETS))
    explain_targets: list[str] = field(default_factory=lambda: list(DEFAULT_TARGETS))


def _known(section: str, given: Mapping, allowed: set[str]) -> None:
    if not isinstance(given, Mapping):
        raise ValueError(f"{section} must be a mapping")
    unknown = sorted(set(given) - allowed)
    if unknown:
        raise ValueError(f"unknown key(s) in {section}: {unknown}; allowed: {sorted(allowed)}")


def _strings(section: str, given: Any) -> list[str]:
    if not isinstance(given, list) or not all(isinstance(x, str) for x in given):
        raise ValueError(f"{section} must be a list of strings")
    return list(given)


def validate(config: Mapping) -> None:
    """Raise ValueError naming the first key or value that is not accepted."""
    _known("settings", config, set(SECTIONS) | {"targets"})
    for section, allowed in SECTIONS.items():
        if section in config:
            _known(section, config[section], allowed)
    reduction = config.get("dimreduce", {})
    wrong = sorted(set(_strings("dimreduce.methods", reduction.get("methods", []))) - METHODS)
    if wrong:
        raise ValueError(f"dimreduce.methods does not know {wrong}; allowed: {sorted(METHODS)}")
    _known("dimreduce.umap", reduction.get("umap", {}), UMAP_KEYS)
    for task, grids in (("classification", CLASSIFICATION_GRIDS), ("regression", REGRESSION_GRIDS)):
        chosen = config.get(task, {}).get("models", {})
        _known(f"{task}.models", chosen, set(grids))
        for model_id, entry in chosen.items():
            _known(f"{task}.models.{model_id}", entry, MODEL_KEYS)
    _strings("targets", config.get("targets", []))
    _strings("explain.targets", config.get("explain", {}).get("targets", []))


def _task(base: TaskSettings, given: Mapping, name: str) -> TaskSettings:
    changes: dict[str, Any] = {}
    for key, attr, kind in (("enabled", "enabled", bool), ("n_outer_folds", "n_outer", int),
                            ("n_inner_folds", "n_inner", int), ("n_iter", "n_iter", int), ("smote", "use_smote", bool)):
        if key in given:
            changes[attr] = kind(given[key])
    if "models" in given:
        on = {m: e for m, e in given["models"].items() if e.get("enabled", True)}
        if not on and changes.get("enabled", base.enabled):
            raise ValueError(f"{name}: every model is disabled; disable the task instead")
        changes["model_filter"] = list(on)
        changes["fixed_params"] = {m: dict(e["params"]) for m, e in on.items() if e.get("params")}
    return replace(base, **changes)


def from_mapping(config: Mapping, base: RunSettings = RunSettings()) -> RunSettings:
    """Settings of a nested mapping on top of `base`."""
    validate(config)
    changes: dict[str, Any] = {}
    top = config.get("global", {})
    for key, attr, kind in (("n_jobs", "parallelism", int), ("random_state", "seed", int), ("corr_threshold", "corr_threshold", float)):
        if key in top:
            changes[attr] = kind(top[key])
    reduction = config.get("dimreduce", {})
    if "methods" in reduction:
        changes["methods"] = list(reduction["methods"])
        changes["skip_reduction"] = base.skip_reduction or not reduction["methods"]
    for key, kind in (("n_neighbors", int), ("min_dist", float)):
        if key in reduction.get("umap", {}):
            changes[key] = kind(reduction["umap"][key])
    changes["classification"] = _task(base.classification, config.get("classification", {}), "classification")
    changes["regression"] = _task(base.regression, config.get("regression", {}), "regression")
    explain = config.get("explain", {})
    if explain.get("enabled", True) is False:
        changes["skip_explain"] = True
    if "targets" in config:
        changes["targets"] = list(config["targets"])
        changes["explain_targets"] = list(config["targets"])
    if "targets" in explain:
        changes["explain_targets"] = list(explain["targets"])
    return replace(base, **changes)
