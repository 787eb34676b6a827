"""Findings: one row for each check of a series, and their verdicts rolled up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import KEY

#: From best to worst; a phase or series takes its worst, but skips only if all are skipped.
VERDICTS = ("SKIP", "PASS", "WARN", "FAIL", "REJECT")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
COLUMNS = (KEY, "phase_no", "phase", "check", "verdict", "severity", "value")


def verdict_rank(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == v, k) for k, v in enumerate(VERDICTS)])


def verdict_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, VERDICTS)), rank)


def ladder(steps: Iterable[tuple[Column, str, str]], otherwise: tuple[str, str] = ("PASS", "INFO")) -> Column:
    """struct(verdict, severity) of the first condition that holds."""
    out = None
    for when, verdict, severity in steps:
        pair = F.struct(F.lit(verdict).alias("verdict"), F.lit(severity).alias("severity"))
        out = F.when(when, pair) if out is None else out.when(when, pair)
    last = F.struct(F.lit(otherwise[0]).alias("verdict"), F.lit(otherwise[1]).alias("severity"))
    return last if out is None else out.otherwise(last)


def check(name: str, judged: Column, value: Column | None = None, given: Column | None = None) -> Column:
    """One finding as a struct; given: whether the check is made at all."""
    value = F.lit(None).cast("double") if value is None else value.cast("double")
    row = F.struct(F.lit(name).alias("check"), judged["verdict"].alias("verdict"), judged["severity"].alias("severity"), value.alias("value"))
    return row if given is None else F.when(given, row)


def skipped(name: str, given: Column | None = None) -> Column:
    return check(name, ladder([], ("SKIP", "INFO")), None, given)


def phase(stats: DataFrame, number: int, name: str, checks: list[Column]) -> DataFrame:
    """The findings of one phase from one row of statistics for each series."""
    rows = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return stats.select(KEY, F.lit(number).alias("phase_no"), F.lit(name).alias("phase"), F.inline(rows))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Worst verdict, and the numbers of red flags and warnings, for each series (and other keys)."""
    rank = F.max(verdict_rank(F.col("verdict")))
    return findings.groupBy(KEY, *keys).agg(
        verdict_name(rank).alias("verdict"), F.count("*").alias("n_findings"),
        F.count_if(F.col("verdict").isin("FAIL", "REJECT")).alias("red_flags"), F.count_if(F.col("verdict") == "WARN").alias("warnings"),
    )


def to_documents(findings: DataFrame) -> DataFrame:
    """series_id, report: the findings of each series as one JSON document, by phase; NaN and infinities as text."""
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), F.col("value").cast("string")).otherwise(F.format_string("%.10g", "value"))
    row = F.struct("phase_no", "phase", "check", "verdict", "severity", value.alias("value"))
    return findings.groupBy(KEY).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("report"))
