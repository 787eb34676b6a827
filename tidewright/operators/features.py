"""Feature columns of a series, for forecasting and system identification; t counts from 0."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import KEY, by_time

LAGS, WINDOWS = (1, 2, 3, 7, 14), (7, 14, 28)


def lag_features(series: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    return series.withColumns({f"lag_{k}": F.lag("value", k).over(by_time()) for k in lags})


def rolling_features(series: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Mean and spread of the w values before each point; null up to and including t = w, by contract."""
    cols = {}
    for w in windows:
        frame = by_time().rowsBetween(-w, -1)
        cols[f"rmean_{w}"] = F.when(F.col("t") > w, F.avg("value").over(frame))
        cols[f"rstd_{w}"] = F.when(F.col("t") > w, F.coalesce(F.stddev_samp("value").over(frame), F.lit(0.0)))
    return series.withColumns(cols)


def calendar_features(series: DataFrame, freq: int = 1) -> DataFrame:
    """time_idx, and with a period also the place in it and which half."""
    cols: dict[str, Column] = {}
    if freq > 1:
        place = F.pmod(F.col("t"), F.lit(freq)).cast("int")
        cols = {"season_idx": place, "season_half": F.when(place < freq // 2, 0).otherwise(1)}
    return series.withColumns({**cols, "time_idx": F.col("t")})


def fourier_features(series: DataFrame, period: int, harmonics: int = 3) -> DataFrame:
    angle = lambda k: F.lit(2 * math.pi * k) * F.col("t") / period
    return series.withColumns({f"{n}_{period}_{k}": f(angle(k)) for k in range(1, harmonics + 1) for n, f in (("sin", F.sin), ("cos", F.cos))})


def feature_matrix(series: DataFrame, freq: int = 1, lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS, harmonics: int = 3) -> DataFrame:
    """All features of the rows that have them all; t says where each row was."""
    out = calendar_features(rolling_features(lag_features(series, lags), windows), freq)
    if freq > 1:
        out = fourier_features(out, freq, harmonics)
    return out.na.drop(subset=[c for c in out.columns if c not in (KEY, "t", "value")])


def arx_regressors(pairs: DataFrame, na: int, nb: int, nk: int = 1) -> DataFrame:
    """series_id, t, y and y1..yna, u0..: past outputs and inputs (from nk steps back), rows without gaps."""
    cols = {f"y{k}": F.lag("y", k).over(by_time()) for k in range(1, na + 1)}
    cols |= {f"u{k}": F.lag("u", nk + k).over(by_time()) for k in range(nb)}
    out = pairs.withColumns(cols).where(F.col("t") >= max(na, nk + nb - 1, 1))
    return out.select(KEY, "t", "y", *cols)


def polynomial_basis(pairs: DataFrame, na: int, nb: int, degree: int, nk: int = 1) -> DataFrame:
    """series_id, t, y and all products of the regressors up to degree, with the constant; names tell the factors."""
    base = arx_regressors(pairs, na, nb, nk)
    names = [c for c in base.columns if c not in (KEY, "t", "y")]
    terms = {"one": F.lit(1.0)}
    for d in range(1, degree + 1):
        for own in combinations_with_replacement(names, d):
            terms["_".join(own)] = reduce(lambda a, b: a * b, [F.col(c) for c in own])
    return base.select(KEY, "t", "y", *[c.alias(n) for n, c in terms.items()])
