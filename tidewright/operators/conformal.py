"""Prediction intervals from calibration errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import KEY


def order_statistic(scores: DataFrame, coverage: float = 0.95, *keys: str) -> DataFrame:
    """series_id, n, threshold, guarantee_ok: the ceil((n + 1) coverage)-th smallest score, the largest at most.

    guarantee_ok says whether that rank exists, without which the coverage is not guaranteed.
    """
    group = Window.partitionBy(KEY, *keys)
    rows = scores.where("score is not null").withColumn("n", F.count("score").over(group)).withColumn("k", F.row_number().over(group.orderBy("score")))
    # A hair less, so that a product that is whole but for rounding counts as whole.
    rank = F.ceil((F.col("n") + 1) * coverage - 1e-9)
    at = F.greatest(F.lit(1), F.least(rank, F.col("n")))
    return rows.groupBy(KEY, *keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("k") == at, F.col("score"))).alias("threshold"), F.min(rank <= F.col("n")).alias("guarantee_ok"))


def intervals(residuals: DataFrame, forecasts: DataFrame, coverage: float = 0.95) -> DataFrame:
    """forecasts (series_id, h, yhat) with lo and hi: as wide as the order statistic of the sizes of residuals.

    A series without residuals keeps its point forecasts as both ends.
    """
    limit = order_statistic(residuals.select(KEY, F.abs("residual").alias("score")), coverage)
    out = forecasts.join(limit, KEY, "left")
    wide = F.coalesce("threshold", F.lit(0.0))
    return out.select(KEY, "h", "yhat", (F.col("yhat") - wide).alias("lo"), (F.col("yhat") + wide).alias("hi"), F.coalesce("guarantee_ok", F.lit(False)).alias("guarantee_ok"))


def cqr(calibration: DataFrame, test: DataFrame, coverage: float = 0.95, fix_crossing: bool = True) -> DataFrame:
    """test (series_id, t, lo, hi) with both ends moved by how far actuals of calibration lay beyond theirs.

    The correction may be negative; ends that cross then meet in their middle. Without calibration
    rows the intervals stay.
    """
    score = F.greatest(F.col("lo") - F.col("actual"), F.col("actual") - F.col("hi"))
    move = order_statistic(calibration.select(KEY, score.alias("score")), coverage).select(KEY, "threshold")
    out = test.join(move, KEY, "left")
    by = F.coalesce("threshold", F.lit(0.0))
    lo, hi = F.col("lo") - by, F.col("hi") + by
    mid = (lo + hi) / 2
    pick = lambda own: F.when(F.lit(fix_crossing) & (lo > hi), mid).otherwise(own)
    return out.select(KEY, "t", pick(lo).alias("lo"), pick(hi).alias("hi"))


