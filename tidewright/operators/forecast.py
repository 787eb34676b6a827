"""Forecasts of many series: simple ones, smoothing, boosted trees; ranking, intervals and findings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conformal, features, metrics, order, review, splits
from .findings import check, ladder, phase, skipped
from .stats import KEY, whole

SIMPLE = ("naive", "seasonal_naive", "drift")


def simple_forecasts(train: DataFrame, horizon: int, period: int = 1) -> DataFrame:
    """series_id, model, h, yhat for h = 1 to horizon: last value, last season again, straight on; seasonal if period > 1."""
    n = F.count("value").over(whole())
    ends = train.groupBy(KEY).agg(F.count("value").alias("n"), F.max_by("value", "t").alias("last"), F.min_by("value", "t").alias("first"), F.max("t").alias("end"))
    steps = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    slope = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))).otherwise(0.0)
    out = steps.select(KEY, F.lit("naive").alias("model"), "h", F.col("last").alias("yhat")).union(steps.select(KEY, F.lit("drift"), "h", F.col("last") + F.col("h") * slope))
    if period > 1:
        tail = train.withColumn("n", n).withColumn("i", F.row_number().over(whole().orderBy("t")) - 1).where((F.col("n") >= period) & (F.col("i") >= F.col("n") - period))
        tail = tail.select(KEY, (F.col("i") - F.col("n") + period).alias("place"), "value")
        season = steps.where(F.col("n") >= period).withColumn("place", F.pmod(F.col("h") - 1, F.lit(period))).join(tail, [KEY, "place"])
        out = out.union(season.select(KEY, F.lit("seasonal_naive"), "h", F.col("value")))
    return out


def moving_average(train: DataFrame, k: int, horizon: int) -> DataFrame:
    """The mean of the last k values, for each step."""
    last = train.withColumn("r", F.row_number().over(whole().orderBy(F.desc("t")))).where(F.col("r") <= k).groupBy(KEY).agg(F.avg("value").alias("yhat"))
    return last.select(KEY, F.lit("moving_average").alias("model"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "yhat")


def smooth(x: np.ndarray, alpha: float, beta: float, gamma: float, phi: float, period: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Squared error of one-step forecasts of additive damped smoothing, fitted values and final state."""
    season = np.zeros(max(1, period))
    level, trend = x[0], 0.0
    if period > 1 and len(x) >= 2 * period:
        level = x[:period].mean()
        season = x[:period] - level
        trend = (x[period : 2 * period].mean() - level) / period
    fitted = np.empty(len(x))
    for t, v in enumerate(x):
        s = season[t % len(season)]
        fitted[t] = level + phi * trend + s
        e = v - fitted[t]
        level, trend = level + phi * trend + alpha * e, phi * trend + alpha * beta * e
        if period > 1:
            season[t % len(season)] += gamma * (1 - alpha) * e
    return float(((x - fitted) ** 2).sum()), fitted, np.r_[level, trend, season]


GRID = tuple((a, b, g, p) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.0, 0.1, 0.3) for g in (0.0, 0.1, 0.3) for p in (0.9, 1.0))


def smoothing_forecasts(train: DataFrame, horizon: int, period: int = 1, least: int = 20) -> DataFrame:
    """series_id, model, h, yhat by exponential smoothing whose parameters a grid search picks; at least least values."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = table["value"].to_numpy()
        h = np.arange(1, horizon + 1)
        if len(x) < least:
            h = h[:0]
        yhat = np.zeros(len(h))
        if len(h):
            grid = [g for g in GRID if period > 1 or g[2] == 0]
            a, b, g, phi = min(grid, key=lambda p: smooth(x, *p, period)[0])
            _, _, state = smooth(x, a, b, g, phi, period)
            damp = np.cumsum(phi**h)
            yhat = state[0] + damp * state[1] + (state[2:][(len(x) + h - 1) % max(1, period)] if period > 1 else 0)
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * len(h), pa.string()), "model": pa.array(["ets"] * len(h), pa.string()), "h": pa.array(h.astype(np.int32)), "yhat": yhat})

    return train.select(F.col(KEY).cast("string").alias(KEY), "t", "value").groupBy(KEY).applyInArrow(one, "series_id string, model string, h int, yhat double")


def autoregression(train: DataFrame, horizon: int, lags: int = 3, least: int = 20) -> DataFrame:
    """series_id, model, h, yhat of an autoregression of the differences, fitted by least squares and rolled forward."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = table["value"].to_numpy()
        d = np.diff(x)
        n = horizon if len(x) >= max(least, 3 * lags + 2) else 0
        out = np.zeros(n)
        if n:
            a = np.stack([np.ones(len(d) - lags), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]], axis=1)
            theta = np.linalg.lstsq(a, d[lags:], rcond=None)[0]
            past, level = list(d[-lags:]), x[-1]
            for h in range(n):
                step = theta[0] + sum(theta[k] * past[-k] for k in range(1, lags + 1))
                past.append(step)
                level += step
                out[h] = level
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * n, pa.string()), "model": pa.array(["ari"] * n, pa.string()), "h": pa.array(np.arange(1, n + 1), pa.int32()), "yhat": out})

    return train.select(F.col(KEY).cast("string").alias(KEY), "t", "value").groupBy(KEY).applyInArrow(one, "series_id string, model string, h int, yhat double")


def boosted_trees(series: DataFrame, until: DataFrame, period: int = 1, rounds: int = 20, lags: tuple[int, ...] = (1, 2, 3), windows: tuple[int, ...] = (6,)) -> DataFrame:
    """series_id, t, yhat: one-step forecasts of the rows from until (series_id, t0) on, by trees fitted on those before.

    One model for all series; each row is scaled by its series' mean, so that they can share it.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    scale = series.join(until, KEY).where("t < t0").groupBy(KEY).agg(F.greatest(F.abs(F.avg("value")), F.lit(1e-12)).alias("scale"))
    own = series.join(scale, KEY).withColumn("value", F.col("value") / F.col("scale"))
    x = features.feature_matrix(own.select(KEY, "t", "value"), period, lags, windows)
    cols = [c for c in x.columns if c not in (KEY, "t", "value")]
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(x).join(until, KEY)
    model = GBTRegressor(labelCol="value", maxIter=rounds, maxDepth=4, seed=42).fit(x.where("t < t0"))
    return model.transform(x.where("t >= t0")).join(scale, KEY).select(KEY, "t", (F.col("prediction") * F.col("scale")).alias("yhat"))


def forecastability(series: DataFrame, period: int = 1) -> DataFrame:
    """Findings of the gate: length, entropy (near random fails), simple errors in the sample, constancy, drift."""
    n = F.count("value").over(whole())
    w = whole().orderBy("t")
    v, last, first = F.col("value"), F.lag("value").over(w), F.first("value").over(w)
    start = F.greatest(F.lit(period + 1), F.floor(n / 4))
    rows = series.select(KEY, n.alias("n"), (F.col("t") >= start).alias("eval"), (n > start + 5).alias("enough"), F.abs(v - last).alias("naive"), F.when((F.lit(period) > 1) & (n > 2 * period), F.abs(v - F.lag("value", period).over(w))).alias("seasonal"), F.abs(v - last - (last - first) / F.greatest(F.lit(1), F.col("t") - 1)).alias("drift"))
    own = lambda c: F.avg(F.when(F.col("eval") & F.col("enough"), F.col(c)))
    b = rows.groupBy(KEY).agg(F.max("n").alias("n"), F.least(own("naive"), own("seasonal"), own("drift")).alias("best"))
    pe = order.permutation_entropy(series.withColumn("o", review.entropy_order(n)), F.col("o"))
    s = b.join(pe, KEY, "left").join(series.groupBy(KEY).agg(F.count_distinct("value").alias("u")), KEY).join(order.half_split(series).select(KEY, "mean_shift"), KEY)
    n, long, e = F.col("n"), F.col("n") >= 10, F.col("pe")
    return phase(s, 1, "forecastability_gate", [
        check("data_length", ladder([(n < 10, "REJECT", "CRITICAL"), (n < 30, "WARN", "MEDIUM")]), n),
        check("permutation_entropy", ladder([(e > 0.95, "FAIL", "HIGH"), (e > 0.85, "WARN", "MEDIUM")]), e, long & e.isNotNull()),
        check("naive_baselines", ladder([]), F.col("best"), long & F.col("best").isNotNull()),
        check("constant_series", ladder([], ("REJECT", "CRITICAL")), None, long & (F.col("u") <= 1)),
        check("low_cardinality", ladder([], ("WARN", "MEDIUM")), F.col("u"), long & (F.col("u") > 1) & (F.col("u") <= 3)),
        check("stationarity_hint", ladder([(F.col("mean_shift") > 2, "WARN", "LOW")]), F.col("mean_shift"), n >= 40),
    ])


def pipeline(series: DataFrame, horizon: int = 12, period: int = 1, coverage: float = 0.95) -> dict[str, DataFrame]:
    """forecasts (with intervals), ranking and findings of each series that the gate lets through.

    Models forecast from the end of the training rows over calibration and test, so that errors
    are those of matching rows; calibration errors give the intervals, test errors the ranking.
    """
    gate = forecastability(series, period)
    out_ = gate.where("verdict = 'REJECT'").select(KEY).distinct()
    sound = series.join(out_, KEY, "left_anti").select(F.col(KEY).cast("string").alias(KEY), "t", "value")
    roles = splits.train_calib_test(sound, horizon)
    train = roles.where("role = 'train'").select(KEY, "t", "value")
    ends = train.groupBy(KEY).agg(F.max("t").alias("t0"))
    size = sound.groupBy(KEY).agg(F.max("t").alias("end"))
    far = ends.join(size, KEY)
    # As far as the longest series needs; a fifth of it and the horizon.
    steps = int(far.agg(F.coalesce(F.max(F.col("end") - F.col("t0")), F.lit(1))).first()[0]) or 1
    made = reduce(DataFrame.unionByName, [simple_forecasts(train, steps, period), smoothing_forecasts(train, steps, period), autoregression(train, steps)])
    placed = made.join(ends, KEY).withColumn("t", F.col("t0") + F.col("h"))
    judged = placed.join(roles.where("role <> 'train'"), [KEY, "t"]).select(KEY, "model", "role", "t", "h", F.col("value").alias("actual"), F.col("yhat").alias("predicted"))
    ranking = metrics.compare_models(judged.where("role = 'test'"), metrics.naive_scale(train, max(1, period)))
    best = ranking.where("rank = 1").select(KEY, "model", "mase", "mae")
    rest = judged.where("role = 'calib'").join(best, [KEY, "model"]).select(KEY, (F.col("actual") - F.col("predicted")).alias("residual"))
    test = judged.where("role = 'test'").join(best.select(KEY, "model"), [KEY, "model"])
    ranges = conformal.intervals(rest, test.select(KEY, "h", F.col("predicted").alias("yhat")), coverage)
    naive = ranking.where("model = 'naive'").select(KEY, F.col("mae").alias("naive_mae"))
    s = best.join(naive, KEY, "left").withColumn("fva", metrics.fva(F.col("mae"), F.col("naive_mae")))
    hit = ranges.join(test.select(KEY, "h", "actual"), [KEY, "h"]).groupBy(KEY).agg(F.avg(((F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi"))).cast("double")).alias("hit"))
    s = s.join(hit, KEY, "left")
    m, v, gap = F.col("mase"), F.col("fva"), F.col("hit") - coverage
    found = gate.union(phase(s, 4, "model_comparison", [
        check("best_model", ladder([(m >= 1.5, "FAIL", "HIGH"), (m >= 1, "WARN", "MEDIUM")]), m, ~F.isnan(m)),
        check("fva", ladder([(v < 0, "FAIL", "HIGH"), (v < 10, "WARN", "MEDIUM")]), v, ~F.isnan(v)),
        skipped("gradient_boosting"),
    ])).union(phase(s, 5, "conformal", [check("coverage", ladder([(gap < -0.10, "FAIL", "HIGH"), (gap < -0.05, "WARN", "MEDIUM")]), F.col("hit"), F.col("hit").isNotNull())]))
    return {"forecasts": ranges.join(best.select(KEY, "model"), KEY), "ranking": ranking, "findings": found}


