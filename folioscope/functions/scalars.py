"""Scalar expressions. All are plain column expressions except `two_sided_t_p`."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label texts that stand for the two encoded genders, and the name layout.
GENDER_CODES = {"Male": 1.0, "male": 1.0, "Female": 0.0, "female": 0.0}
NAME_SEPARATOR = "__"
SHORT_NAME_LENGTH = 45
FILE_NAME_LENGTH = 40


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c: str | Column) -> Column:
    """Numeric coercion: anything that is not a real number becomes NULL."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def encode_gender(c: str | Column) -> Column:
    """Male 1, Female 0 (either capitalisation), everything else NULL."""
    out = F.lit(None).cast("double")
    for text, code in GENDER_CODES.items():
        out = F.when(col(c) == text, F.lit(code)).otherwise(out)
    return out


def clip(value: Column, lo: Column, hi: Column) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL, which bare `least`/`greatest` would not keep."""
    return F.when(value.isNotNull(), F.greatest(lo, F.least(hi, value)))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def path_stem(c: str | Column) -> Column:
    """Last path component without its last suffix; a leading dot is part of the name."""
    name = F.regexp_extract(col(c), r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def feature_name(metric: Column, variant: Column, stat: Column) -> Column:
    return F.concat_ws(NAME_SEPARATOR, metric, variant, stat)


def feature_name_parts(c: str | Column) -> Column:
    """Struct (metric, variant, stat), split from the right so metrics may hold underscores."""
    parts = F.split(col(c), NAME_SEPARATOR)
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), n - 2), NAME_SEPARATOR).alias("metric"),
        F.element_at(parts, -2).alias("variant"),
        F.element_at(parts, -1).alias("stat"),
    )


def shorten(c: str | Column, width: int = SHORT_NAME_LENGTH) -> Column:
    c = col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def file_safe(c: str | Column, width: int = FILE_NAME_LENGTH) -> Column:
    return F.substring(F.translate(col(c), "/ ", "__"), 1, width)


def is_label(c: str | Column) -> Column:
    """A usable class label: not NULL, not blank and not the text `nan`."""
    c = col(c)
    return c.isNotNull() & (F.trim(c) != "") & (F.lower(c) != "nan")


def hash_int(*parts: Column) -> Column:
    """First 32 bits of an md5 over the parts: the same number in every engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column) -> Column:
    """Deterministic draw in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)


def log_grid(lo_exp: float, hi_exp: float, points: int) -> Column:
    """Array of `points` values spaced evenly on a base-10 log scale."""
    step = (hi_exp - lo_exp) / (points - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.pow(F.lit(10.0), F.lit(float(lo_exp)) + i * F.lit(step)),
    )


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for step in range(400):
        m = step // 2
        if step == 0:
            num = 1.0
        elif step % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * (f - 1.0)


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a correlation under Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or not (n > 2) or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2.0
    t2 = r * r * dof / (1.0 - r * r)
    return _beta_tail(dof / 2.0, 0.5, dof / (dof + t2))


@F.pandas_udf(T.DoubleType())
def two_sided_t_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(np.array([correlation_p(a, b) for a, b in zip(r, n)], dtype=float))
