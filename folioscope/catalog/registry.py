"""Collects the catalog modules."""

from __future__ import annotations

from folioscope.catalog import evaluation, explanation, extraction, modelling, neighbourhood, preprocessing, reduction, runs

MODULES = [extraction, evaluation, preprocessing, neighbourhood, modelling, reduction, explanation, runs]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
