"""Unit-root and level-stationarity tests from their published formulas; one series in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import check, ladder, phase, skipped
from .stats import KEY

#: Response surfaces of the Dickey-Fuller test with a constant (level, then 1/T, 1/T^2, 1/T^3).
DICKEY_FULLER = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: Upper tail and critical value of the level-stationarity test.
KPSS = ((0.10, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739))


def critical(level: float, n: int) -> float:
    a, b, c, d = DICKEY_FULLER[level]
    return a + b / n + c / n**2 + d / n**3


def dickey_fuller(x: np.ndarray, most: int | None = None) -> tuple[float, int, int]:
    """t of the level in the regression of differences on level, constant and lagged differences; lags by AIC on common rows."""
    most = min(int(12 * (len(x) / 100) ** 0.25) if most is None else most, max(0, len(x) // 2 - 3))
    d = np.diff(x)

    def fit(lags: int, start: int) -> tuple[float, float, int]:
        y = d[start:]
        cols = [x[start:-1], np.ones(len(y)), *[d[start - k : len(d) - k] for k in range(1, lags + 1)]]
        a = np.stack(cols, axis=1)
        theta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rest = y - a @ theta
        n, k = a.shape
        rss = max(float(rest @ rest), 1e-300)
        se = np.sqrt(max(np.linalg.pinv(a.T @ a)[0, 0] * rss / max(n - k, 1), 1e-300))
        return n * np.log(rss / n) + 2 * k, theta[0] / se, n

    lags = min(range(most + 1), key=lambda k: fit(k, most)[0])
    _, t, n = fit(lags, lags)
    return float(t), lags, n


def kpss(x: np.ndarray) -> tuple[float, float]:
    """Statistic and p (between 0.01 and 0.10) of stationarity around a level, with Bartlett weights."""
    e = x - x.mean()
    n, lags = len(e), int(12 * (len(e) / 100) ** 0.25)
    s2 = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    eta = float((np.cumsum(e) ** 2).sum() / n**2 / max(s2, 1e-300))
    return eta, float(np.interp(eta, [c for _, c in KPSS], [p for p, _ in KPSS]))


def unit_root_tests(series: DataFrame, least: int = 20) -> DataFrame:
    """series_id, n, adf, lags, adf_5 (critical value), unit_root, kpss, kpss_p; constant and shorter series give nulls."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = table["value"].to_numpy()
        row = [table[KEY][0].as_py(), len(x), None, None, None, None, None, None]
        if len(x) >= least and x.max() > x.min():
            t, lags, n = dickey_fuller(x)
            row[2:] = [t, lags, critical(0.05, n), t >= critical(0.05, n), *kpss(x)]
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.float64())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [KEY, "n", "adf", "lags", "adf_5", "unit_root", "kpss", "kpss_p"])

    own = series.select(F.col(KEY).cast("string").alias(KEY), "t", F.col("value").cast("double").alias("value"))
    return own.groupBy(KEY).applyInArrow(one, "series_id string, n long, adf double, lags int, adf_5 double, unit_root boolean, kpss double, kpss_p double")


def stationarity_findings(series: DataFrame) -> DataFrame:
    """Phase 3 by tests instead of halves: series, and their differences."""
    from .order import diff

    d = diff(series).withColumn("t", F.col("t") - 1)
    s = unit_root_tests(series).join(unit_root_tests(d).select(KEY, F.col("adf").alias("d_adf"), F.col("unit_root").alias("d_root")), KEY, "left")
    tested = F.col("adf").isNotNull()
    return phase(s, 3, "stationarity_tests", [
        skipped("stationarity", ~tested),
        check("adf_test", ladder([(F.col("unit_root"), "WARN", "MEDIUM")]), F.col("adf"), tested),
        check("kpss_test", ladder([(F.col("kpss_p") <= 0.05, "WARN", "MEDIUM")]), F.col("kpss"), tested),
        check("diff_stationarity", ladder([(F.col("d_root"), "WARN", "MEDIUM")]), F.col("d_adf"), tested & F.col("d_adf").isNotNull()),
    ])
