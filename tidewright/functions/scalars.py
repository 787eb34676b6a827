"""Scalar formulas as columns, and special functions for rows that are already few."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-3
INF = float("inf")


def clamp_probability(p: Column, eps: float = EPS) -> Column:
    """p within eps and 1 - eps; a p that is no finite number is an error."""
    bad = F.isnan(p) | (F.abs(p) == INF)
    return F.when(bad, F.raise_error(F.lit("a probability must be a finite number")).cast("double")).otherwise(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p)))


def bayes_update(prior: Column, ratio: Column, eps: float = EPS) -> Column:
    """Posterior by odds times likelihood ratio, clamped before and after; ratio 0 gives eps, a negative one is an error."""
    p = clamp_probability(prior, eps)
    odds = p / (1 - p) * ratio
    out = F.when(ratio < 0, F.raise_error(F.lit("a likelihood ratio must not be negative")).cast("double"))
    return out.when((prior <= 0) | (prior >= 1), F.raise_error(F.lit("a prior must lie between 0 and 1")).cast("double")).when(ratio == 0, eps).otherwise(clamp_probability(odds / (1 + odds), eps))


def odds_update(prior: Column, ratio: Column) -> Column:
    """The variant of inference chains, without checks: a ratio of 0 or less gives 0.001, all stays within 0.001 and 0.999."""
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), prior))
    odds = p / (1 - p) * ratio
    return F.when(ratio <= 0, EPS).otherwise(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), odds / (1 + odds))))


def next_pow2(n: Column) -> Column:
    """The smallest power of two that is not below n, by shifts, as logarithms may be off by one."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long") - 1))).cast("long"))


def parse_bool(text: Column) -> Column:
    """True 1 yes y t, false 0 no n f, in any case; anything else is an error."""
    own = F.lower(F.trim(text))
    return F.when(own.isin("true", "1", "yes", "y", "t"), True).when(own.isin("false", "0", "no", "n", "f"), False).otherwise(F.raise_error(F.lit("neither true nor false")).cast("boolean"))


def parse_plausibility(text: Column) -> Column:
    """'a,b,c,d' as four numbers, each null if left out; another count is an error."""
    parts = F.transform(F.split(text, ","), lambda x: F.nullif(F.trim(x), F.lit("")).try_cast("double"))
    return F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.lit("four values are needed")).cast("array<double>"))


def parse_aliases(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def natural_key(name: Column) -> list[Column]:
    """Columns that sort H2 before H10."""
    return [F.regexp_extract(name, r"^(.*?)(\d*)$", 1), F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(0))]


def next_counter(names: Column, prefix: str) -> Column:
    """Aggregate: one more than the largest number behind the prefix."""
    return F.coalesce(F.max(F.when(names.startswith(prefix), F.substring(names, len(prefix) + 1, 20).try_cast("long"))), F.lit(0)) + 1


def tokens(text: Column) -> Column:
    """The set of words of a text: small letters, commas as spaces."""
    return F.array_distinct(F.filter(F.split(F.lower(F.replace(text, F.lit(","), F.lit(" "))), r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# --- special functions: numpy over columns of few rows ----------------------------------------


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # front over the fraction 1 + k1 / (1 + k2 / (1 + ...))
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1, 400):
        m = i // 2
        k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or 1e-30)
        c = 1 + k / c or 1e-30
        value *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front / value


def student_sf(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * incomplete_beta(df / (df + t * t), df / 2, 0.5)


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_sf_value(q: float, df: float) -> float:
    """Wilson and Hilferty's normal approximation of the chi-square survival function."""
    if not math.isfinite(q) or df <= 0:
        return math.nan
    if q <= 0:
        return 1.0
    z = ((q / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return min(1.0, 2 * student_sf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic p of the two-sample Kolmogorov-Smirnov statistic."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-9:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(a, int(b)) for a, b in zip(r, n, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_sf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_value(a, b) for a, b in zip(q, df, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_p_value(*x) if np.isfinite(x[0]) else np.nan for x in zip(d, n, m, strict=True)], dtype=float)
