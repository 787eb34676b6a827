"""Screening: flags and coherence checks counted into verdicts, metrics held against calibrated bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories of flags, their severities.
FLAG_CATEGORIES = ("methodology", "documentation", "results", "claims", "tool_worship", "statistical")
SEVERITIES = ("minor", "major", "critical")
#: Domain, metric, suspicious, plausible from, plausible to, excellent.
BOUNDS = (
    ("ml_classification", "accuracy", 0.99, 0.7, 0.9, 0.98),
    ("ml_classification", "f1", 0.99, 0.7, 0.9, 0.98),
    ("ml_classification", "auc", 0.999, 0.7, 0.9, 0.98),
    ("ml_regression", "r2", 0.99, 0.7, 0.9, 0.98),
    ("ml_regression", "mape", 0.01, 0.15, 0.05, 0.02),
    ("financial_prediction", "directional_accuracy", 0.65, 0.52, 0.58, 0.62),
    ("financial_prediction", "sharpe", 3.0, 0.5, 1.5, 2.5),
    ("financial_prediction", "r2_returns", 0.3, 0.01, 0.05, 0.15),
    ("financial_prediction", "r2_prices", 0.95, 0.3, 0.7, 0.85),
    ("financial_prediction", "annual_alpha", 0.3, 0.02, 0.08, 0.15),
    ("financial_prediction", "mcc", 0.6, 0.02, 0.1, 0.25),
    ("financial_prediction", "max_drawdown", 0.05, 0.5, 0.2, 0.1),
    ("financial_prediction", "r2_returns_train", 0.05, 0.8, 0.5, 0.3),
    ("engineering", "r2_insample", 1.0, 0.85, 0.95, 0.99),
    ("engineering", "r2_outsample", 0.99, 0.8, 0.9, 0.98),
    ("engineering", "mape", 0.01, 0.15, 0.05, 0.02),
    ("medical", "sensitivity", 0.99, 0.7, 0.85, 0.95),
    ("medical", "specificity", 0.99, 0.7, 0.85, 0.95),
    ("medical", "auc", 0.99, 0.7, 0.85, 0.95),
    ("time_series", "mase", 0.3, 1.5, 0.8, 0.5),
    ("time_series", "r2", 0.99, 0.5, 0.85, 0.95),
    ("time_series", "coverage_80", 1.0, 0.6, 0.75, 0.85),
    ("time_series", "mape", 0.005, 0.3, 0.1, 0.03),
    ("organizational", "employee_retention", 0.99, 0.7, 0.85, 0.95),
    ("organizational", "revenue_growth", 0.5, 0.02, 0.15, 0.3),
    ("organizational", "cost_reduction", 0.6, 0.05, 0.2, 0.4),
    ("organizational", "customer_satisfaction", 0.99, 0.6, 0.8, 0.95),
    ("organizational", "process_efficiency_gain", 0.8, 0.05, 0.25, 0.5),
)


def bounds(spark: SparkSession) -> DataFrame:
    """domain, metric, suspicious, plausible_low, plausible_high, excellent: a small table of fixed size."""
    return spark.createDataFrame(BOUNDS, "domain string, metric string, suspicious double, plausible_low double, plausible_high double, excellent double")


def calibrate(values: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """values (domain, metric, value, ...) with assessment; the bounds tell whether lower is better."""
    table = F.broadcast(bounds(values.sparkSession)) if table is None else table
    out = values.join(table, ["domain", "metric"], "left")
    v, lower = F.col("value"), F.col("suspicious") < F.col("excellent")
    within = lambda limit: F.when(lower, v <= F.col(limit)).otherwise(v >= F.col(limit))
    a = F.when(F.col("suspicious").isNull(), "unknown").when(within("suspicious"), "suspicious").when(within("excellent"), "excellent").when(within("plausible_high"), "plausible")
    a = a.when(within("plausible_low"), "plausible_poor").otherwise("implausible")
    return out.select(*values.columns, a.alias("assessment"))


def flag_counts(flags: DataFrame, categories: tuple[str, ...] = (), *keys: str) -> DataFrame:
    """Counts by category and by severity in one pass, and in all; categories without flags are 0.

    kind says which: category, severity or total.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), name.alias("name")) for k, name in (("category", F.col("category")), ("severity", F.col("severity")), ("total", F.lit("all")))])
    out = flags.select(*keys, F.inline(kinds)).groupBy(*keys, "kind", "name").agg(F.count("*").alias("n"))
    if not categories:
        return out
    dim = flags.sparkSession.createDataFrame([(c,) for c in categories], "name string").withColumn("kind", F.lit("category"))
    dim = dim.crossJoin(flags.select(*keys).distinct()) if keys else dim  # a few fixed names for each subject
    return dim.join(out, [*keys, "kind", "name"], "full").select(*keys, "kind", "name", F.coalesce("n", F.lit(0)).alias("n"))


def latest_checks(checks: DataFrame, *keys: str) -> DataFrame:
    """The last status of each kind of coherence check by seq."""
    return checks.groupBy(*keys, "check_type").agg(F.max_by("status", "seq").alias("status"))


def coherence_summary(checks: DataFrame, *keys: str) -> DataFrame:
    c = latest_checks(checks, *keys).groupBy(*keys)
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed")).withColumn("all_passed", (F.col("total") > 0) & (F.col("passed") == F.col("total")))


def ladder(critical: Column, failed: Column, flags: Column, categories: Column, suspicious: Column | None = None) -> Column:
    """The verdict from counts; without calibrations only flags and checks count."""
    s = F.lit(0) if suspicious is None else suspicious
    out = F.when((critical > 0) | (failed > 0), "REJECT").when((flags > 5) | (categories >= 4), "REJECT")
    return out.when((flags >= 4) | (categories >= 3) | (s >= 2), "DOUBTFUL").when((flags >= 2) | (s >= 1), "SKEPTICAL").otherwise("CREDIBLE")


def verdict(subjects: DataFrame, flags: DataFrame, checks: DataFrame | None = None, calibrations: DataFrame | None = None, *, key: str = "subject") -> DataFrame:
    """key, counts and verdict of each subject; tables that hold nothing on it count as 0."""
    f = flags.groupBy(key).agg(F.count("*").alias("total_flags"), F.count_distinct("category").alias("categories"), F.count_if(F.col("severity") == "critical").alias("critical"))
    out = subjects.select(key).join(f, key, "left")
    out = out.join(coherence_summary(checks, key).select(key, "failed"), key, "left") if checks is not None else out.withColumn("failed", F.lit(0))
    if calibrations is not None:
        c = calibrations.groupBy(key).agg(F.count_if(F.col("assessment") == "suspicious").alias("suspicious"))
        out = out.join(c, key, "left")
    else:
        out = out.withColumn("suspicious", F.lit(0))
    names = ("total_flags", "categories", "critical", "failed", "suspicious")
    out = out.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return out.withColumn("verdict", ladder(F.col("critical"), F.col("failed"), F.col("total_flags"), F.col("categories"), F.col("suspicious")))
