"""Which rows of a series train, calibrate and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import KEY, whole


def walk_forward(series: DataFrame, folds: int = 5, min_train: int = 30, horizon: int = 1, expanding: bool = True) -> DataFrame:
    """series_id, t, value, fold, role: a row for each fold in which a point trains or tests.

    Up to horizon points give nothing; fewer than min_train + horizon one fold that tests the last.
    """
    n = F.count("value").over(whole())
    rows = series.withColumn("n", n).where(F.col("n") > horizon)
    short = F.col("n") < min_train + horizon
    step = F.greatest(F.lit(1), F.floor((F.col("n") - min_train) / folds))
    rows = rows.withColumn("fold", F.explode(F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(folds - 1)))))
    start = F.when(short, F.col("n") - horizon).otherwise(min_train + F.col("fold") * step)
    first = F.lit(0) if expanding else F.when(short, F.lit(0)).otherwise(F.greatest(F.lit(0), start - min_train))
    role = F.when((F.col("t") >= first) & (F.col("t") < start), "train").when((F.col("t") >= start) & (F.col("t") < start + horizon), "test")
    rows = rows.withColumn("role", role).where((start < F.col("n")) & F.col("role").isNotNull())
    return rows.select(KEY, "t", "value", "fold", "role")


def train_calib_test(series: DataFrame, horizon: int = 1) -> DataFrame:
    """series_id, t, value, role: test min(horizon, max(1, n div 5)), of the rest a fifth calibrates.

    With fewer than 10 to train on, all train and the others are parts of the same tail, so a point
    may have several rows.
    """
    rows = series.withColumn("n", F.count("value").over(whole()))
    test = F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    rest = F.col("n") - test
    calib = F.greatest(F.lit(1), F.floor(rest / 5))
    train = rest - calib
    few = train < 10
    first = F.greatest(F.lit(0), rest - F.greatest(F.lit(5), F.floor(F.col("n") / 4)))
    t = F.col("t")
    roles = F.array(
        F.when(few | (t < train), "train"),
        F.when(F.when(few, (t >= first) & (t < rest)).otherwise((t >= train) & (t < rest)), "calib"),
        F.when(t >= rest, "test"),
    )
    return rows.select(KEY, "t", "value", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role"))


def blocked_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """The rows with fold and role: fold k trains on the first k + 2 of folds + 1 blocks and tests on the next.

    Blocks are as long as n div (folds + 1), so the last fold tests the few rows that are left
    beyond them. Folds that would test fewer than 3 rows, and blocks under 5, are left out.
    """
    rows = rows.withColumn("n", F.count("*").over(whole())).withColumn("i", F.row_number().over(whole().orderBy("t")) - 1)
    size = F.floor(F.col("n") / (folds + 1))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = (F.col("fold") + 2) * size
    stop = F.least(start + size, F.col("n"))
    role = F.when(F.col("i") < start, "train").when(F.col("i") < stop, "test")
    return rows.withColumn("role", role).where(F.col("role").isNotNull() & (stop - start >= 3) & (size >= 5)).drop("n", "i")
