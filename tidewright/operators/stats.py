"""Descriptive statistics of many series in one aggregate each.

A series is a long table of series_id, t (from 0, without gaps after cleaning) and value. All
functions return lazily planned tables with one row for each series unless they say otherwise.
Empty input gives 0 for means, spreads and percentiles, as the analytics built on them expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_id"


def by_time(key: str = KEY, order: str = "t"):
    return Window.partitionBy(key).orderBy(order)


def whole(key: str = KEY):
    return Window.partitionBy(key)


def mean(x: Column | str = "value") -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def std(x: Column | str = "value", ddof: int = 1) -> Column:
    """0 for fewer than two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.stddev_samp(x) if ddof else F.stddev_pop(x))


def percentile(q: float, x: Column | str = "value") -> Column:
    """Exact, linear between ranks; q from 0 to 100."""
    return F.coalesce(F.percentile(x, F.lit(q / 100)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation; 0 where either side does not vary."""
    return F.coalesce(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def skewness(x: Column | str = "value") -> Column:
    return F.when(F.stddev_pop(x) > 0, F.skewness(x)).otherwise(0.0)


def kurtosis(x: Column | str = "value") -> Column:
    """Fourth moment over the squared variance: 3 for a normal law."""
    return F.when(F.stddev_pop(x) > 0, F.kurtosis(x) + 3).otherwise(0.0)


def profile(series: DataFrame) -> DataFrame:
    """n, mean, std, min, max, median, quartiles, distinct values, and the shares of the extremes."""
    both = series.withColumn("lo", F.min("value").over(whole())).withColumn("hi", F.max("value").over(whole()))
    share = lambda c: F.avg((F.col("value") == F.col(c)).cast("double"))
    return both.groupBy(KEY).agg(
        F.count("value").alias("n"), mean().alias("mean"), std().alias("std"), F.max("lo").alias("min"), F.max("hi").alias("max"),
        percentile(50).alias("median"), percentile(25).alias("q1"), percentile(75).alias("q3"),
        F.count_distinct("value").alias("n_unique"), share("lo").alias("share_min"), share("hi").alias("share_max"),
    )


def iqr_outliers(series: DataFrame, k: float = 1.5, extreme: float = 3.0) -> DataFrame:
    """Tukey's fences and how many values lie beyond them, and beyond the far ones."""
    fences = series.groupBy(KEY).agg(percentile(25).alias("q1"), percentile(75).alias("q3"), F.count("value").alias("n"))
    wide = F.col("q3") - F.col("q1")
    fences = fences.select(KEY, "n", (F.col("q1") - k * wide).alias("lo"), (F.col("q3") + k * wide).alias("hi"), (F.col("q1") - extreme * wide).alias("lo_far"), (F.col("q3") + extreme * wide).alias("hi_far"))
    out = series.join(fences, KEY)
    beyond = lambda a, b: F.count_if((F.col("value") < F.col(a)) | (F.col("value") > F.col(b)))
    return out.groupBy(KEY).agg(F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), beyond("lo", "hi").alias("n_out"), beyond("lo_far", "hi_far").alias("n_extreme"))


def correlation(x: DataFrame, y: DataFrame, key: str = KEY) -> DataFrame:
    """n and r of two series tables, joined on key and t."""
    both = x.select(key, "t", F.col("value").alias("x")).join(y.select(key, "t", F.col("value").alias("y")), [key, "t"])
    return both.groupBy(key).agg(F.count("*").alias("n"), pearson("x", "y").alias("r"))
