"""The review of series: ten phases of checks, each from one row of statistics for each series.

The branches are those that need no statistics library; thresholds are part of the contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, order
from .findings import check, ladder, phase, skipped
from .stats import KEY, iqr_outliers, mean, profile, std

INF = float("inf")


def _all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, KEY, "left"), tables)


def coherence(series: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Phase 1: length, parse failures, constancy, clipping. raw: series_id, n_raw (default: nothing was lost)."""
    s = profile(series)
    s = (raw.join(s, KEY, "left") if raw is not None else s.withColumn("n_raw", F.col("n"))).withColumn("n", F.coalesce("n", F.lit(0)))
    n, uniq = F.col("n"), F.col("n_unique")
    lost = F.when(F.col("n_raw") > 0, 100 * (F.col("n_raw") - n) / F.nullif("n_raw", F.lit(0))).otherwise(0.0)
    clip = F.greatest("share_min", "share_max")
    return phase(s, 1, "coherence", [
        check("min_length", ladder([(n < 10, "REJECT", "CRITICAL"), (n < 30, "WARN", "MEDIUM")]), n),
        check("parse_failures", ladder([(lost > 20, "FAIL", "HIGH"), (lost > 5, "WARN", "MEDIUM")]), lost),
        check("constant_series", ladder([], ("REJECT", "CRITICAL")), None, (n > 1) & (uniq == 1)),
        check("low_cardinality", ladder([], ("WARN", "MEDIUM")), uniq, (n > 1) & (uniq > 1) & (uniq <= 3)),
        check("value_diversity", ladder([]), uniq, (n > 1) & (uniq > 3)),
        check("value_clipping", ladder([(clip > 0.10, "WARN", "MEDIUM")]), clip, (n > 10) & (F.col("max") > F.col("min"))),
    ])


def data_quality(series: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Phase 2: missing values, outliers, duplicate times, stuck values. raw: series_id, n_raw[, n_times]."""
    s = _all(iqr_outliers(series), order.stuck_runs(series).select(KEY, "max_run"))
    s = (raw.join(s, KEY, "left") if raw is not None else s.withColumn("n_raw", F.col("n"))).withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n")
    lost = F.when(F.col("n_raw") > 0, 100 * (F.col("n_raw") - n) / F.nullif("n_raw", F.lit(0))).otherwise(0.0)
    out, run = 100 * F.col("n_out") / F.nullif(n, F.lit(0)), F.col("max_run")
    checks = [
        check("missing_values", ladder([(lost > 20, "FAIL", "HIGH"), (lost > 5, "WARN", "MEDIUM")]), lost),
        check("outliers_iqr", ladder([(out > 10, "WARN", "MEDIUM")]), out, n >= 20),
        check("extreme_outliers", ladder([(F.col("n_extreme") > 0, "WARN", "HIGH")]), F.col("n_extreme"), n >= 20),
        skipped("outliers_iqr", n < 20),
    ]
    if "n_times" in s.columns:
        twice = F.col("n_raw") - F.col("n_times")
        checks.append(check("duplicate_timestamps", ladder([(twice > 0, "WARN", "MEDIUM")]), twice))
    stuck = ladder([(100 * run / F.nullif(n, F.lit(0)) > 10, "WARN", "HIGH"), (run > F.greatest(F.lit(5.0), n * 0.02), "WARN", "LOW")])
    return phase(s, 2, "data_quality", [*checks, check("stuck_values", stuck, run, n > 10)])


def stationarity(series: DataFrame) -> DataFrame:
    """Phase 3: shift of the mean and ratio of the spreads between halves."""
    s = order.half_split(series)
    n, shift, spread = F.col("n"), F.col("mean_shift"), F.col("std_ratio")
    return phase(s, 3, "stationarity", [
        skipped("stationarity", n < 20),
        check("mean_shift_heuristic", ladder([(shift > 1.5, "WARN", "MEDIUM")]), shift, n >= 20),
        check("variance_ratio_heuristic", ladder([((spread > 2) | (spread < 0.5), "WARN", "MEDIUM")]), spread, n >= 20),
    ])


def entropy_order(n: Column) -> Column:
    return F.when(n < 200, 3).when(n < 1000, 4).otherwise(5)


def forecastability(series: DataFrame, infer: bool = True, max_lag: int = 40) -> DataFrame:
    """Phase 4: autocorrelation, persistence, entropies, signal to noise, and the period if none is given."""
    acfs = order.acf(series, max_lag)
    edge = 2 / F.sqrt(F.col("n").cast("double"))
    beyond = (F.col("lag") >= 1) & (F.abs("acf") > edge)
    a = acfs.groupBy(KEY).agg(F.max("n").alias("n"), F.count_if(beyond).alias("n_sig"), F.sum(F.when((F.col("lag") >= 1) & (F.col("lag") <= 20), F.col("acf") ** 2)).alias("energy"), F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("lag1"))
    length = F.count("value").over(Window.partitionBy(KEY))
    pe = order.permutation_entropy(series.withColumn("o", entropy_order(length)), F.col("o"))
    s = _all(a, order.direction_entropy(series).select(KEY, "entropy"), pe, order.diff_snr(series).select(KEY, "snr"), order.infer_seasonality(acfs))
    n, long = F.col("n"), F.col("n") >= 20
    return phase(s, 4, "forecastability", [
        skipped("forecastability", ~long),
        check("acf_structure", ladder([(F.col("n_sig") == 0, "WARN", "HIGH")]), F.col("energy"), long),
        check("lag1_persistence", ladder([(F.abs("lag1") < edge, "WARN", "MEDIUM")]), F.col("lag1"), long),
        check("direction_entropy", ladder([(F.col("entropy") > 0.95, "WARN", "MEDIUM")]), F.col("entropy"), n >= 50),
        check("permutation_entropy", ladder([(F.col("pe") > 0.95, "WARN", "HIGH"), (F.col("pe") > 0.85, "WARN", "MEDIUM")]), F.col("pe"), long & F.col("pe").isNotNull()),
        check("snr_diffs", ladder([(F.col("snr") < 0.05, "WARN", "MEDIUM")]), F.col("snr"), long),
        check("inferred_seasonality", ladder([]), F.col("period"), F.lit(infer) & (n >= 50) & F.col("period").isNotNull()),
    ])


def decomposition(series: DataFrame, period: int = 2) -> DataFrame:
    """Phase 5: strength of a moving-average trend, and breaks of the variance between segments."""
    s = _all(series.groupBy(KEY).agg(F.count("value").alias("n")), order.trend_strength(series, period).select(KEY, "trend_strength"), order.structural_break(series).select(KEY, "segments", "ratio"))
    n, r = F.col("n"), F.col("ratio")
    return phase(s, 5, "decomposition", [
        skipped("decomposition", n < 30),
        check("trend_strength_heuristic", ladder([]), F.col("trend_strength"), (n >= 30) & F.col("trend_strength").isNotNull()),
        check("structural_break", ladder([(r > 4, "WARN", "HIGH"), (r > 2, "WARN", "LOW")]), r, (n >= 60) & (F.col("segments") >= 3)),
    ])


def baselines(series: DataFrame, pairs: DataFrame | None = None, period: int = 1) -> DataFrame:
    """Phase 6: the best simple forecast, and how a model's (series_id, t, actual, predicted) compares.

    The model's scaled error takes its scale from its own actuals, as no training data are given.
    """
    s = metrics.baseline_errors(series, period)
    n = F.col("n")
    checks = [skipped("baselines", n < 10), check("baseline_errors", ladder([]), F.col("best_mae"), n >= 10)]
    if pairs is not None:
        scale = metrics.naive_scale(pairs.select(KEY, "t", F.col("actual").alias("value")), period)
        m = pairs.groupBy(KEY).agg(F.count("*").alias("n_cmp"), metrics.mae().alias("mae"), metrics.rmse().alias("rmse")).join(scale, KEY, "left")
        s = s.join(m, KEY, "left").withColumn("mase", metrics.scaled(F.col("mae"), F.col("abs_scale"))).withColumn("fva", metrics.fva(F.col("mae"), F.col("best_mae")))
        given = (n >= 10) & (F.col("n_cmp") >= 5)
        checks += [
            check("model_mae", ladder([]), F.col("mae"), given),
            check("model_rmse", ladder([]), F.col("rmse"), given),
            check("model_mase", ladder([(F.col("mase") >= 1.5, "FAIL", "HIGH"), (F.col("mase") >= 1, "WARN", "MEDIUM")]), F.col("mase"), given & ~F.isnan("mase")),
            check("fva", ladder([(F.col("fva") < 0, "FAIL", "HIGH"), (F.col("fva") < 10, "WARN", "MEDIUM")]), F.col("fva"), given & ~F.isnan("fva")),
        ]
    return phase(s, 6, "baselines", checks)


def overfitting(pairs: DataFrame) -> DataFrame:
    """Phase 7 over series_id, split ('train' or 'test'), actual, predicted."""
    m = pairs.groupBy(KEY, "split").agg(F.count("*").alias("n"), metrics.r_squared().alias("r2"), metrics.mae().alias("mae"))
    of = lambda c, split: F.max(F.when(F.col("split") == split, F.col(c))).alias(f"{split}_{c}")
    s = m.groupBy(KEY).agg(*[of(c, k) for c in ("n", "r2", "mae") for k in ("train", "test")])
    n, r, tr = F.coalesce("test_n", F.lit(0)), F.col("test_r2"), F.col("train_r2")
    both = (n >= 5) & (F.col("train_n") >= 5)
    sound, gap = both & ~F.isnan(r) & ~F.isnan(tr), tr - r
    more = F.col("test_mae") / F.nullif("train_mae", F.lit(0.0))
    return phase(s, 7, "overfitting", [
        skipped("overfitting", n < 5),
        check("test_r2", ladder([(r > 0.99, "REJECT", "CRITICAL"), (r > 0.95, "FAIL", "HIGH"), (r < 0, "FAIL", "HIGH")]), r, (n >= 5) & ~F.isnan(r)),
        check("train_r2_memorization", ladder([], ("REJECT", "CRITICAL")), tr, both & ~F.isnan(tr) & (tr >= 0.9999)),
        check("train_r2", ladder([], ("WARN", "HIGH")), tr, both & ~F.isnan(tr) & (tr > 0.99) & (tr < 0.9999)),
        check("test_better_than_train", ladder([], ("REJECT", "CRITICAL")), r, sound & (r > tr + 0.01)),
        check("overfit_gap", ladder([(gap > 0.3, "FAIL", "HIGH"), (gap > 0.15, "WARN", "MEDIUM")]), gap, sound),
        check("mae_gap", ladder([(more > 3, "FAIL", "HIGH"), (more > 1.5, "WARN", "MEDIUM")]), more, both & (F.col("test_mae") > 0) & (F.col("train_mae") > 0)),
    ])


def residuals(series: DataFrame) -> DataFrame:
    """Phase 8: bias, autocorrelation and steadiness of residuals (as values of series)."""
    edge = 2 / F.sqrt(F.col("n").cast("double"))
    acfs = order.acf(series, 20).where(F.col("lag") <= F.least(F.lit(20), F.floor(F.col("n") / 3)))
    sig = acfs.groupBy(KEY).agg(F.count_if((F.col("lag") >= 1) & (F.abs("acf") > edge)).alias("n_sig"))
    s = _all(series.groupBy(KEY).agg(F.count("value").alias("n"), mean().alias("m"), std().alias("s")), sig, order.half_split(series).select(KEY, "std_ratio"))
    n = F.col("n")
    t = F.when(F.col("s") > 0, F.abs("m") / F.nullif(F.col("s") / F.sqrt(n.cast("double")), F.lit(0.0))).otherwise(INF)
    spread = F.col("std_ratio")
    return phase(s, 8, "residuals", [
        skipped("residuals", n < 10),
        check("residual_bias", ladder([(t > 2.576, "FAIL", "HIGH"), (t > 1.96, "WARN", "MEDIUM")]), t, n >= 10),
        check("residual_acf", ladder([(F.col("n_sig") > 0, "FAIL", "HIGH")]), F.col("n_sig"), n >= 10),
        check("residual_heteroscedasticity", ladder([((spread > 2) | (spread < 0.5), "WARN", "MEDIUM")]), spread, n >= 10),
    ])


def uncertainty(rows: DataFrame, coverage: float = 0.95) -> DataFrame:
    """Phase 9 over series_id, actual, lo, hi."""
    s = metrics.interval_quality(rows, coverage)
    n, gap = F.col("n"), F.col("coverage") - coverage
    return phase(s, 9, "uncertainty", [
        skipped("uncertainty", n < 10),
        check("coverage", ladder([(gap < -0.10, "FAIL", "HIGH"), (gap < -0.03, "WARN", "MEDIUM"), (gap > 0.10, "WARN", "LOW")]), F.col("coverage"), n >= 10),
        check("interval_width", ladder([(F.col("relative_width") > 1, "WARN", "MEDIUM")]), F.col("relative_width"), n >= 10),
        check("interval_consistency", ladder([(F.col("width_cv") > 0.5, "WARN", "LOW")]), F.col("width_cv"), n >= 20),
        check("winkler_score", ladder([]), F.col("winkler"), n >= 10),
    ])


def regimes(series: DataFrame, windows: int = 5) -> DataFrame:
    """Phase 10: drift of the mean and clustering of the spread over equal slices."""
    s = order.regime_summary(series, windows)
    n, drift, vol = F.col("n"), F.col("mean_drift"), F.col("vol_ratio")
    return phase(s, 10, "regimes", [
        skipped("regimes", n < 50),
        check("regime_mean_drift", ladder([(drift > 2, "WARN", "HIGH"), (drift > 1, "WARN", "MEDIUM")]), drift, n >= 50),
        check("volatility_clustering", ladder([(vol > 3, "WARN", "HIGH"), (vol > 1.5, "WARN", "LOW")]), vol, n >= 50),
        check("regime_recommendation", ladder([], ("WARN", "MEDIUM")), drift, (n >= 50) & ((drift > 1.5) | (vol > 2.5))),
    ])


def full_review(series: DataFrame, period: int | None = None, pairs: DataFrame | None = None, splits: DataFrame | None = None, rest: DataFrame | None = None, intervals: DataFrame | None = None, windows: int = 5) -> DataFrame:
    """All findings. A series that phase 1 rejects has none beyond it; phases 7 to 9 need their tables."""
    first = coherence(series)
    rejected = first.where("verdict = 'REJECT'").select(KEY).distinct()
    sound = series.join(rejected, KEY, "left_anti")
    parts = [data_quality(sound), stationarity(sound), forecastability(sound, infer=period is None), decomposition(sound, period or 2), baselines(sound, pairs, period or 1)]
    if splits is not None:
        parts.append(overfitting(splits.join(rejected, KEY, "left_anti")))
    if rest is not None:
        parts.append(residuals(rest.join(rejected, KEY, "left_anti")))
    if intervals is not None:
        parts.append(uncertainty(intervals.join(rejected, KEY, "left_anti")))
    return reduce(DataFrame.unionByName, [*parts, regimes(sound, windows)], first)


def quick_review(series: DataFrame, period: int | None = None) -> DataFrame:
    """Phases 1 to 6."""
    return full_review(series, period).where("phase_no <= 6")
