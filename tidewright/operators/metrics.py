"""Forecast errors over (actual, predicted) rows; all are aggregates, so any grouping works.

Pairs are joined on their key before; NaN stands for a metric that is not defined (no rows, no
scale), as opposed to null for missing input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import KEY, by_time

NAN = float("nan")


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))


def mae(a: str = "actual", p: str = "predicted") -> Column:
    return _or_nan(F.avg(F.abs(F.col(a) - F.col(p))))


def rmse(a: str = "actual", p: str = "predicted") -> Column:
    return _or_nan(F.sqrt(F.avg((F.col(a) - F.col(p)) ** 2)))


def r_squared(a: str = "actual", p: str = "predicted") -> Column:
    total = F.var_pop(a) * F.count(a)
    return _or_nan(F.when(F.count(a) >= 2, 1 - F.sum((F.col(a) - F.col(p)) ** 2) / F.nullif(total, F.lit(0.0))))


def wape(a: str = "actual", p: str = "predicted") -> Column:
    return _or_nan(100 * F.sum(F.abs(F.col(a) - F.col(p))) / F.nullif(F.sum(F.abs(a)), F.lit(0.0)))


def bias(a: str = "actual", p: str = "predicted") -> Column:
    """Positive: forecasts are too high."""
    return _or_nan(F.avg(F.col(p) - F.col(a)))


def pinball(tau: float, a: str = "actual", p: str = "predicted") -> Column:
    rest = F.col(a) - F.col(p)
    return _or_nan(F.avg(F.when(rest >= 0, tau * rest).otherwise((tau - 1) * rest)))


def fva(model_mae: Column, naive_mae: Column) -> Column:
    """Improvement over the naive error in percent."""
    return _or_nan(100 * (naive_mae - model_mae) / F.nullif(naive_mae, F.lit(0.0)))


def scaled(error: Column, scale: Column) -> Column:
    """An error over that of the seasonal naive forecast in the sample: MASE from absolute, RMSSE from root mean squares."""
    return _or_nan(error / F.nullif(scale, F.lit(0.0)))


def naive_scale(series: DataFrame, period: int = 1) -> DataFrame:
    """series_id, abs_scale, rms_scale: in-sample errors of the seasonal naive forecast."""
    step = F.col("value") - F.lag("value", period).over(by_time())
    return series.withColumn("e", step).groupBy(KEY).agg(F.avg(F.abs("e")).alias("abs_scale"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms_scale"))


def compare_models(pairs: DataFrame, scale: DataFrame) -> DataFrame:
    """series_id, model, all metrics, and the rank by MASE (undefined last, then by name)."""
    m = pairs.groupBy(KEY, "model").agg(F.count("*").alias("n"), mae().alias("mae"), rmse().alias("rmse"), r_squared().alias("r2"), wape().alias("wape"), bias().alias("bias"))
    m = m.join(scale, KEY, "left").withColumn("mase", scaled(F.col("mae"), F.col("abs_scale"))).withColumn("rmsse", scaled(F.col("rmse"), F.col("rms_scale")))
    order = Window.partitionBy(KEY).orderBy(F.isnan("mase"), "mase", "model")
    return m.withColumn("rank", F.row_number().over(order)).drop("abs_scale", "rms_scale")


def baseline_errors(series: DataFrame, period: int = 1) -> DataFrame:
    """Mean absolute errors of the naive, seasonal naive, drift and mean forecasts, and the best of them.

    One window for each series. seasonal: only if period > 1 and n > 2 period. drift from t = 2,
    mean from t = max(10, n div 5). Of equal ones the first in this order is the best.
    """
    w = by_time()
    v, t, n = F.col("value"), F.col("t"), F.count("value").over(Window.partitionBy(KEY))
    last, first = F.lag("value").over(w), F.first("value").over(w)
    rows = series.select(
        KEY, n.alias("n"), F.abs(v - last).alias("naive"),
        F.when((F.lit(period) > 1) & (n > 2 * period), F.abs(v - F.lag("value", period).over(w))).alias("seasonal"),
        F.when(t >= 2, F.abs(v - (last + (last - first) / F.nullif((t - 1).cast("double"), F.lit(0.0))))).alias("drift"),
        F.when(t >= F.greatest(F.lit(10), F.floor(n / 5)), F.abs(v - F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)))).alias("mean"),
    )
    kinds = ("naive", "seasonal", "drift", "mean")
    out = rows.groupBy(KEY).agg(F.max("n").alias("n"), *[F.avg(k).alias(f"{k}_mae") for k in kinds])
    ranked = F.array(*[F.struct(F.col(f"{k}_mae").alias("mae"), F.lit(i).alias("rank"), F.lit({"seasonal": "seasonal_naive"}.get(k, k)).alias("name")) for i, k in enumerate(kinds)])
    best = F.array_min(F.filter(ranked, lambda x: x["mae"].isNotNull()))
    return out.select("*", best["name"].alias("best"), best["mae"].alias("best_mae"))


def info_criteria(n: Column, k: Column, rss: Column) -> dict[str, Column]:
    """AIC, BIC, AICc and FPE; NaN without rows or residuals, infinite without degrees of freedom."""
    bad = (n <= 0) | (rss <= 0)
    n, k = n.cast("double"), k.cast("double")
    fit = n * F.log(F.when(~bad, rss / n))
    free = n - k - 1
    aic = fit + 2 * k
    return {
        "aic": F.when(bad, NAN).otherwise(aic),
        "bic": F.when(bad, NAN).otherwise(fit + k * F.log(F.when(n > 0, n))),
        "aicc": F.when(bad, NAN).when(free <= 0, float("inf")).otherwise(aic + 2 * k * (k + 1) / F.nullif(free, F.lit(0.0))),
        "fpe": F.when(bad, NAN).when(n - k <= 0, float("inf")).otherwise(rss / F.nullif(n, F.lit(0.0)) * (n + k) / F.nullif(n - k, F.lit(0.0))),
    }


def interval_quality(rows: DataFrame, coverage: float = 0.95, *keys: str) -> DataFrame:
    """Coverage, mean and relative width, its variation, and Winkler score of (actual, lo, hi) rows."""
    a, lo, hi = F.col("actual"), F.col("lo"), F.col("hi")
    wide, far = hi - lo, 2 / (1 - coverage)
    winkler = wide + F.when(a < lo, far * (lo - a)).when(a > hi, far * (a - hi)).otherwise(0.0)
    agg = rows.groupBy(KEY, *keys).agg(
        F.count("*").alias("n"), F.avg(((a >= lo) & (a <= hi)).cast("double")).alias("coverage"), F.avg(wide).alias("mean_width"),
        (F.max("actual") - F.min("actual")).alias("range"), F.coalesce(F.stddev_samp(wide), F.lit(0.0)).alias("width_std"), F.avg(winkler).alias("winkler"),
    )
    relative = F.when(F.col("range") > 0, F.col("mean_width") / F.nullif("range", F.lit(0.0))).otherwise(float("inf"))
    cv = F.when(F.col("mean_width") > 0, F.col("width_std") / F.nullif("mean_width", F.lit(0.0))).otherwise(0.0)
    return agg.select(KEY, *keys, "n", "coverage", "mean_width", relative.alias("relative_width"), cv.alias("width_cv"), "winkler")
