"""Operators that depend on the order of a series: lags, runs, entropies, segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import KEY, by_time, mean, ratio, std, whole


def diff(series: DataFrame) -> DataFrame:
    """First differences, without the first row."""
    step = F.col("value") - F.lag("value").over(by_time())
    return series.withColumn("value", step).where("value is not null")


def diff_snr(series: DataFrame) -> DataFrame:
    """Size of the mean step over the spread of the steps; infinite where all steps are equal."""
    d = diff(series).groupBy(KEY).agg(F.count("*").alias("n"), F.abs(mean()).alias("m"), std().alias("s"))
    return d.select(KEY, "n", F.when(F.col("s") > 0, F.col("m") / F.nullif("s", F.lit(0.0))).otherwise(float("inf")).alias("snr"))


def acf(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """series_id, lag, acf for lags 0 to min(max_lag, n div 2).

    All lags come from one window pass and partial sums, so a long series costs no exploded rows.
    Without variance lag 0 is 1 and the others are 0.
    """
    n, avg = F.count("value").over(whole()), F.avg("value").over(whole())
    dev = series.select(KEY, "t", n.alias("n"), (F.col("value") - avg).alias("x"))
    lagged = dev.select(KEY, "n", "x", *[F.lag("x", k).over(by_time()).alias(f"x{k}") for k in range(1, max_lag + 1)])
    sums = lagged.groupBy(KEY).agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("v"), *[F.sum(F.col("x") * F.col(f"x{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    rows = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[F.struct(F.lit(k).alias("lag"), F.coalesce(ratio(F.col(f"s{k}"), F.col("v")), F.lit(0.0)).alias("acf")) for k in range(1, max_lag + 1)])
    return sums.select(KEY, "n", F.inline(rows)).where((F.col("lag") <= F.floor(F.col("n") / 2))).select(KEY, "n", "lag", "acf")


def acf_join(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """The same for few very long series: rows meet their lagged ones by a keyed join, in any number of tasks."""
    stats = series.groupBy(KEY).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    dev = series.join(stats, KEY).select(KEY, "n", "v", "t", (F.col("value") - F.col("m")).alias("x"))
    ahead = dev.select(KEY, (F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).alias("lag"), "t", F.col("x").alias("y")).withColumn("t", F.col("t") + F.col("lag"))
    sums = dev.join(ahead, [KEY, "t"]).groupBy(KEY, "lag").agg(F.max("n").alias("n"), F.max("v").alias("v"), F.sum(F.col("x") * F.col("y")).alias("s"))
    return sums.select(KEY, "n", "lag", F.coalesce(ratio(F.col("s"), F.col("v") * F.col("n")), F.lit(0.0)).alias("acf")).where(F.col("lag") <= F.floor(F.col("n") / 2))


def ljung_box(acfs: DataFrame, lags: Column | int = 20) -> DataFrame:
    """n, lags, q of the portmanteau statistic over the first lags autocorrelations."""
    lags = F.lit(lags) if isinstance(lags, int) else lags
    rows = acfs.withColumn("lags", lags.cast("int")).where((F.col("lag") >= 1) & (F.col("lag") <= F.col("lags")))
    n = F.col("n").cast("double")
    q = rows.groupBy(KEY, "n", "lags").agg(F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).alias("s"))
    return q.select(KEY, "n", "lags", (n * (n + 2) * F.col("s")).alias("q"))


def stuck_runs(series: DataFrame) -> DataFrame:
    """n and the longest run of equal neighbouring values."""
    new = F.when(F.col("value") == F.lag("value").over(by_time()), 0).otherwise(1)
    runs = series.withColumn("new", new).withColumn("run", F.sum("new").over(by_time()))
    runs = runs.groupBy(KEY, "run").agg(F.count("*").alias("length"))
    return runs.groupBy(KEY).agg(F.sum("length").alias("n"), F.max("length").alias("max_run"))


def direction_entropy(series: DataFrame) -> DataFrame:
    """Entropy of up, down and flat steps over its largest value."""
    d = diff(series).groupBy(KEY).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in (("up", F.col("value") > 0), ("down", F.col("value") < 0), ("flat", F.col("value") == 0))])
    part = lambda c: F.when(F.col(c) > 0, -(F.col(c) / F.col("n")) * F.log2(F.col(c) / F.col("n"))).otherwise(0.0)
    return d.select(KEY, "n", "up", "down", "flat", ((part("up") + part("down") + part("flat")) / math.log2(3)).alias("entropy"))


def permutation_entropy(series: DataFrame, order: Column | int = 3, largest: int = 5) -> DataFrame:
    """Entropy of the ordinal patterns of order values in a row over its largest value; ties keep their order.

    order may be a column, up to largest. Too short series give null.
    """
    order = (F.lit(order) if isinstance(order, int) else order).cast("int")
    points = F.array(*[F.struct(F.lead("value", k).over(by_time()).alias("v"), F.lit(k).alias("i")) for k in range(largest)])
    n = F.count("value").over(whole())
    rows = series.select(KEY, "t", n.alias("n"), order.alias("o"), points.alias("p")).where(F.col("t") <= F.col("n") - F.col("o"))
    pattern = F.transform(F.array_sort(F.slice("p", F.lit(1), F.col("o"))), lambda x: x["i"])
    counts = rows.groupBy(KEY, "o", F.array_join(pattern.cast("array<string>"), ",").alias("pattern")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(KEY))
    parts = counts.withColumn("p", F.col("c") / total)
    most = F.get(F.array(*[F.lit(math.log(max(2, math.factorial(k)))) for k in range(largest + 1)]), F.col("o"))
    return parts.groupBy(KEY, "o").agg(F.sum(-F.col("p") * F.log("p")).alias("h")).select(KEY, F.col("o").alias("order"), (F.col("h") / most).alias("pe"))


def infer_seasonality(acfs: DataFrame) -> DataFrame:
    """The lag of the highest local peak of the autocorrelation beyond lag 1 that stands out; ties to the smaller."""
    by_lag = Window.partitionBy(KEY).orderBy("lag")
    a = F.col("acf")
    peaks = acfs.withColumn("before", F.lag("acf").over(by_lag)).withColumn("after", F.lead("acf").over(by_lag))
    peaks = peaks.where((F.col("lag") >= 2) & (a > F.col("before")) & (a > F.col("after")) & (a > 2 / F.sqrt(F.col("n").cast("double"))) & (a > 0.1))
    return peaks.groupBy(KEY).agg(F.min(F.struct((-a).alias("x"), "lag")).alias("b")).select(KEY, F.col("b.lag").alias("period"))


def half_split(series: DataFrame) -> DataFrame:
    """Shift of the mean between halves in units of the spread, and the ratio of the halves' spreads."""
    rows = series.withColumn("n", F.count("value").over(whole())).withColumn("first", F.col("t") < F.floor(F.col("n") / 2))
    half = lambda f, first: f(F.when(F.col("first") == first, F.col("value")))
    agg = rows.groupBy(KEY).agg(F.max("n").alias("n"), half(mean, True).alias("m1"), half(mean, False).alias("m2"), half(std, True).alias("s1"), half(std, False).alias("s2"), std().alias("s"))
    return agg.select(KEY, "n", (F.abs(F.col("m2") - F.col("m1")) / F.greatest(F.col("s"), F.lit(1e-12))).alias("mean_shift"), (F.greatest(F.col("s1"), F.lit(1e-12)) / F.greatest(F.col("s2"), F.lit(1e-12))).alias("std_ratio"))


def trend_strength(series: DataFrame, period: int = 2) -> DataFrame:
    """1 less the share of variance left after a centred moving average; null where the window is under 3."""
    n = F.count("value").over(whole())
    rows = series.withColumn("n", n).withColumn("w", F.least(F.lit(period if period >= 3 else 5), F.floor(F.col("n") / 3)).cast("int"))
    # The half width is a column only through short series; each possible one is a frame of its own.
    halves = sorted({min(period if period >= 3 else 5, k) // 2 for k in range(3, max(4, (period if period >= 3 else 5) + 1))})
    trend = F.coalesce(*[F.when(F.floor(F.col("w") / 2) == h, F.avg("value").over(by_time().rowsBetween(-h, h))) for h in halves])
    rows = rows.withColumn("rest", F.col("value") - trend)
    v = rows.where("w >= 3").groupBy(KEY).agg(F.max("n").alias("n"), F.var_pop("value").alias("v"), F.var_pop("rest").alias("r"))
    return v.select(KEY, "n", F.when(F.col("v") > 0, F.greatest(F.lit(0.0), 1 - ratio(F.col("r"), F.col("v")))).otherwise(0.0).alias("trend_strength"))


def _segments(series: DataFrame) -> DataFrame:
    """Rows of overlapping segments: length max(20, n div 5), a new one each half length."""
    rows = series.withColumn("n", F.count("value").over(whole())).withColumn("w", F.greatest(F.lit(20), F.floor(F.col("n") / 5)).cast("long"))
    step = F.floor(F.col("w") / 2)
    # A row lies in the segments that start at most w - 1 before it.
    low = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("w")) / step) + 1)
    high = F.least(F.floor(F.col("t") / step), F.floor((F.col("n") - F.col("w")) / step))
    return rows.where("n >= w").where(low <= high).select(KEY, "n", "value", F.explode(F.sequence(low, high)).alias("segment"))


def structural_break(series: DataFrame) -> DataFrame:
    """Segments, and the largest over the smallest variance among them; infinite where one does not vary."""
    v = _segments(series).groupBy(KEY, "n", "segment").agg(F.var_pop("value").alias("v"))
    out = v.groupBy(KEY, "n").agg(F.count("*").alias("segments"), F.max("v").alias("a"), F.min("v").alias("b"))
    return out.select(KEY, "n", "segments", F.when(F.col("b") > 0, F.col("a") / F.nullif("b", F.lit(0.0))).otherwise(float("inf")).alias("ratio"))


def regime_windows(series: DataFrame, windows: int = 5) -> DataFrame:
    """series_id, win, n, mean, std of equal slices; what is left over belongs to the last."""
    rows = series.withColumn("n", F.count("value").over(whole()))
    size = F.greatest(F.floor(F.col("n") / windows), F.lit(1))
    rows = rows.withColumn("win", F.least(F.floor(F.col("t") / size), F.lit(windows - 1)))
    return rows.groupBy(KEY, "win").agg(F.count("*").alias("n"), mean().alias("mean"), std().alias("std"))


def regime_summary(series: DataFrame, windows: int = 5) -> DataFrame:
    """Range of the slices' means in units of the whole spread, and the ratio of their spreads."""
    w = regime_windows(series, windows).groupBy(KEY).agg((F.max("mean") - F.min("mean")).alias("range"), F.max("std").alias("a"), F.min("std").alias("b"))
    s = series.groupBy(KEY).agg(F.count("value").alias("n"), std().alias("s"))
    return w.join(s, KEY).select(KEY, "n", F.coalesce(ratio(F.col("range"), F.col("s")), F.lit(0.0)).alias("mean_drift"), F.when(F.col("b") > 0, F.col("a") / F.nullif("b", F.lit(0.0))).otherwise(float("inf")).alias("vol_ratio"))


def ks_neighbours(series: DataFrame, windows: int = 5) -> DataFrame:
    """series_id, win, d, n, m: largest distance of the distribution functions of each slice and the next."""
    rows = series.withColumn("n", F.count("value").over(whole()))
    size = F.greatest(F.floor(F.col("n") / windows), F.lit(1))
    rows = rows.select(KEY, "value", F.least(F.floor(F.col("t") / size), F.lit(windows - 1)).alias("w"))
    left = rows.where(F.col("w") < windows - 1).select(KEY, F.col("w").alias("win"), "value", F.lit(1).alias("a"), F.lit(0).alias("b"))
    right = rows.where("w > 0").select(KEY, (F.col("w") - 1).alias("win"), "value", F.lit(0).alias("a"), F.lit(1).alias("b"))
    pair = Window.partitionBy(KEY, "win")
    both = left.union(right).groupBy(KEY, "win", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = pair.orderBy("value")
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(pair) - F.sum("b").over(upto) / F.sum("b").over(pair))
    out = both.withColumn("gap", gap).withColumn("n", F.sum("a").over(pair)).withColumn("m", F.sum("b").over(pair))
    return out.groupBy(KEY, "win").agg(F.max("gap").alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def settling(series: DataFrame, band: float = 0.02) -> DataFrame:
    """The first t from which the value stays within band of its last one; for a last value of 0 the band is absolute."""
    last = F.last("value").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = series.withColumn("final", last)
    out = F.abs(F.col("value") - F.col("final")) > F.greatest(F.abs("final") * band, F.lit(1e-12) if band else F.lit(0.0))
    return rows.groupBy(KEY).agg(F.max("final").alias("final"), (F.coalesce(F.max(F.when(out, F.col("t"))), F.lit(-1)) + 1).alias("settled_at"))


def moving_average_snr(series: DataFrame) -> DataFrame:
    """Variance of a zero-padded moving average over that of what it leaves; window n div 10, odd, from 3 to 21."""
    n = F.count("value").over(whole())
    rows = series.withColumn("n", n)
    # n div 10 between 3 and 21, made odd.
    width = F.least(F.lit(21), F.greatest(F.lit(3), F.floor(F.col("n") / 10)))
    rows = rows.withColumn("w", F.when(width % 2 == 0, width + 1).otherwise(width).cast("int"))
    smooth = F.coalesce(*[F.when(F.col("w") == w, F.sum("value").over(by_time().rowsBetween(-(w // 2), w // 2)) / w) for w in range(3, 23, 2)])
    rows = rows.withColumn("s", smooth)
    v = rows.groupBy(KEY).agg(F.max("n").alias("n"), F.max("w").alias("w"), F.var_pop("s").alias("a"), F.var_pop(F.col("value") - F.col("s")).alias("b"))
    return v.select(KEY, "n", "w", F.when(F.col("b") > 0, ratio(F.col("a"), F.col("b"))).otherwise(float("inf")).alias("snr"))


