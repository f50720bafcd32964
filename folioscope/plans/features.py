"""Feature extraction: entities and frame logs to a feature matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import clean_double, encode_gender
from folioscope.operators.stats import MIN_VALID, feature_rows
from folioscope.sources.tables import missing_sources


@dataclass
class Extraction:
    """`features` is long (entity_id, feature, metric, variant, stat, value)."""

    features: DataFrame
    entities: DataFrame
    skipped: DataFrame


def entity_selection(
    entities: DataFrame, path: str, label: str, allowed: Sequence[str] | None = None,
    order: str | None = None, first: int | None = None,
) -> DataFrame:
    """Entities with a log path and an allowed label; `first` keeps the first N by `order`."""
    kept = entities.where(F.col(path).isNotNull())
    if allowed is not None:
        kept = kept.where(F.col(label).isin(list(allowed)))
    if first is not None:
        kept = kept.orderBy(order).limit(first)
    return kept


def present_columns(df: DataFrame, wanted: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """The wanted and extra columns that exist, in order, each once."""
    return [c for c in dict.fromkeys([*wanted, *extra]) if c in df.columns]


def select_features(rows: DataFrame, variant: str | None = None, stat: str | None = None) -> DataFrame:
    if variant is not None:
        rows = rows.where(F.col("variant") == variant)
    if stat is not None:
        rows = rows.where(F.col("stat") == stat)
    return rows


def assemble_rows(
    rows: DataFrame, meta: DataFrame, age: str | None = None, gender: str | None = None,
    key: str = "entity_id",
) -> DataFrame:
    """Long matrix (key, feature, value, block): age and gender come before the metrics."""
    parts = []
    if age is not None and age in meta.columns:
        parts.append(meta.select(key, F.lit(age).alias("feature"), clean_double(age).alias("value"), F.lit(0).alias("block")))
    if gender is not None and gender in meta.columns:
        parts.append(meta.select(key, F.lit(gender).alias("feature"), encode_gender(gender).alias("value"), F.lit(1).alias("block")))
    out = rows.join(meta.select(key), key, "left_semi").select(key, "feature", "value", F.lit(2).alias("block"))
    for part in reversed(parts):
        out = part.unionByName(out)
    return out


def extract_features(
    frames: DataFrame, entities: DataFrame, key: str, numeric: Mapping[tuple[str, str], Column],
    boolean: Mapping[str, Column] | None = None, min_valid: int = MIN_VALID,
) -> Extraction:
    """Statistics of the selected entities only; entities without frames are reported."""
    wanted = frames.join(entities.select(key), key, "left_semi")
    return Extraction(
        features=feature_rows(wanted, key, numeric, boolean, min_valid),
        entities=entities,
        skipped=missing_sources(entities, frames, key),
    )
