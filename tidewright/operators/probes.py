"""Probing systems: test signals, step responses, experiments, dependencies, models from data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import student_sf
from ..sources.work import work_dir
from .stats import KEY, by_time


# --- signals ----------------------------------------------------------------------------------


def chirp(grid: DataFrame, f0: float, f1: float, duration: float, amplitude: float = 1.0) -> DataFrame:
    """grid (t) with u: a sine whose frequency runs evenly from f0 to f1."""
    t = F.col("t").cast("double")
    return grid.withColumn("u", amplitude * F.sin(2 * math.pi * (f0 * t + (f1 - f0) / (2 * duration) * t * t)))


def multisine(grid: DataFrame, frequencies: list[float], amplitude: float = 1.0) -> DataFrame:
    """grid (t) with u: sines of equal size whose phases keep the peak low."""
    n = len(frequencies)
    waves = [F.sin(2 * math.pi * f * F.col("t").cast("double") + math.pi * k * (k + 1) / n) for k, f in enumerate(frequencies)]
    return grid.withColumn("u", amplitude / math.sqrt(n) * sum(waves[1:], waves[0]))


def prbs(spark: SparkSession, length: int, bits: int = 7, amplitude: float = 1.0, seed: int = 1) -> DataFrame:
    """t, u: a pseudo-random binary signal from a shift register, by one fold over its length."""
    taps = {3: (3, 2), 4: (4, 3), 5: (5, 3), 6: (6, 5), 7: (7, 6), 9: (9, 5), 10: (10, 7), 11: (11, 9), 15: (15, 14)}[bits]
    seed = seed % (1 << bits) or 1

    def step(a: Column, _: Column) -> Column:
        s = a["s"]
        bit = (F.shiftright(s, taps[0] - 1).bitwiseXOR(F.shiftright(s, taps[1] - 1))).bitwiseAND(F.lit(1))
        return F.struct((F.shiftleft(s, 1).bitwiseAND(F.lit((1 << bits) - 1))).bitwiseOR(bit).alias("s"), F.concat(a["out"], F.array(s.bitwiseAND(F.lit(1)))).alias("out"))

    begin = F.struct(F.lit(seed).alias("s"), F.array().cast("array<int>").alias("out"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(length)), begin, step)["out"]
    return spark.range(1).select(F.posexplode(out).alias("t", "b")).select("t", (amplitude * (2 * F.col("b") - 1)).cast("double").alias("u"))


def boundary_cases(ranges: DataFrame) -> DataFrame:
    """param, kind, value: the ends of each range (param, low, high), just beyond and within, the middle and zero."""
    step = F.greatest((F.col("high") - F.col("low")) / 1000, F.lit(1e-9))
    cases = {"low": F.col("low"), "high": F.col("high"), "below": F.col("low") - step, "above": F.col("high") + step, "low_inside": F.col("low") + step, "high_inside": F.col("high") - step, "middle": (F.col("low") + F.col("high")) / 2, "zero": F.lit(0.0)}
    return ranges.select("param", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("value")) for k, v in cases.items()])))


# --- responses and experiments ----------------------------------------------------------------


def step_response(series: DataFrame, target: float = 1.0, band: float = 0.02) -> DataFrame:
    """series_id, final, rise_time (10 to 90 % of the final value), overshoot in percent, settled_at, error against target."""
    last = F.last("value").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = series.withColumn("final", last)
    v, f = F.col("value"), F.col("final")
    share = F.when(f != 0, v / F.nullif(f, F.lit(0.0)))
    at = lambda q: F.min(F.when(share >= q, F.col("t")))
    out = F.abs(v - f) > band * F.abs(f)
    a = rows.groupBy(KEY).agg(F.max("final").alias("final"), (at(0.9) - at(0.1)).alias("rise_time"), F.greatest(F.lit(0.0), 100 * (F.max(share) - 1)).alias("overshoot"), (F.coalesce(F.max(F.when(out, F.col("t"))), F.lit(-1)) + 1).alias("settled_at"))
    return a.withColumn("error", F.lit(float(target)) - F.col("final"))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if not math.isfinite(a) or not math.isfinite(b) or b <= 0 else min(1.0, 2 * student_sf(abs(a), b)) for a, b in zip(t.fillna(math.nan), df.fillna(math.nan), strict=True)], dtype=float)


def two_sample(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n1, n0, difference, t, df of value with arm true against false, without assuming equal variances."""
    arm = lambda f, a: f(F.when(F.col("arm") == F.lit(a), F.col("value")))
    g = rows.groupBy(*keys).agg(*[arm(f, a).alias(f"{n}{int(a)}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for a in (True, False)])
    a, b = F.col("v1") / F.nullif("n1", F.lit(0)), F.col("v0") / F.nullif("n0", F.lit(0))
    df = (a + b) ** 2 / F.nullif(a * a / F.nullif(F.col("n1") - 1, F.lit(0)) + b * b / F.nullif(F.col("n0") - 1, F.lit(0)), F.lit(0.0))
    return g.select(*keys, "n1", "n0", (F.col("m1") - F.col("m0")).alias("difference"), ((F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(a + b), F.lit(0.0))).alias("t"), df.alias("df"))


def main_effects(rows: DataFrame, factors: list[str]) -> DataFrame:
    """factor, effect: mean of value where a two-level factor (boolean) is on, less where it is off."""
    own = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("on")) for f in factors])
    long = rows.select("value", F.inline(own))
    return long.groupBy("factor").agg((F.avg(F.when(F.col("on"), F.col("value"))) - F.avg(F.when(~F.col("on"), F.col("value")))).alias("effect"))


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """src, dst, hops of all that can be reached, with the fewest hops; paths double each round until none is new.

    Each round is written to the shared folder, which cuts its lineage. An error if rounds do not do.

    The result may be as large as the square of the nodes of a component: meant for dependency
    graphs, not for social ones.
    """
    now = edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("hops", F.lit(1))
    seen: tuple = ()
    for _ in range(rounds):
        more = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        now = now.union(more).groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        path = work_dir(edges.sparkSession)
        now.write.parquet(path)
        now = edges.sparkSession.read.parquet(path)
        mark = tuple(now.agg(F.count("*"), F.sum("hops")).first())
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError(f"no fixed point after {rounds} rounds: paths of more than 2^{rounds - 1} edges")


def propagate(terms: DataFrame) -> DataFrame:
    """key, mean, std of a sum of independent weighted terms (key, weight, mean, std)."""
    return terms.groupBy("key").agg(F.sum(F.col("weight") * F.col("mean")).alias("mean"), F.sqrt(F.sum((F.col("weight") * F.col("std")) ** 2)).alias("std"))


# --- models from data -------------------------------------------------------------------------


def dynamic_modes(states: DataFrame, columns: list[str], rank: int = 0) -> DataFrame:
    """series_id, mode, re, im, size: eigenvalues of the linear map from each state to the next (one series in a task)."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = np.stack([table[c].to_numpy() for c in columns])
        values, weight = np.zeros(0, complex), np.zeros(0)
        if x.shape[1] > len(columns):
            u, s, vt = np.linalg.svd(x[:, :-1], full_matrices=False)
            r = min(rank or len(s), int((s > 1e-12 * s[0]).sum()))
            if r:
                a = u[:, :r].T @ x[:, 1:] @ vt[:r].T / s[:r]
                values, vectors = np.linalg.eig(a)
                weight = np.abs(np.linalg.lstsq(u[:, :r] @ vectors, x[:, 0].astype(complex), rcond=None)[0])
        order = np.argsort(-weight, kind="stable")
        k = len(values)
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * k, pa.string()), "mode": pa.array(np.arange(k, dtype=np.int32)), "re": values.real[order], "im": values.imag[order], "size": weight[order]})

    own = states.select(F.col(KEY).cast("string").alias(KEY), "t", *[F.col(c).cast("double") for c in columns])
    return own.groupBy(KEY).applyInArrow(one, "series_id string, mode int, re double, im double, size double")


def sparse_dynamics(states: DataFrame, columns: list[str], dt: float, threshold: float = 0.1, rounds: int = 10) -> DataFrame:
    """series_id, target, term, value: derivatives as few terms of degree two or less, by thresholded least squares."""
    names = ["1", *columns, *[f"{a}*{b}" for i, a in enumerate(columns) for b in columns[i:]]]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = np.stack([table[c].to_numpy() for c in columns], axis=1)
        out = []
        if len(x) > len(names) + 2:
            slope, mid = (x[2:] - x[:-2]) / (2 * dt), x[1:-1]
            phi = np.stack([np.ones(len(mid)), *mid.T, *[mid[:, i] * mid[:, j] for i in range(len(columns)) for j in range(i, len(columns))]], axis=1)
            for k, target in enumerate(columns):
                keep = np.ones(len(names), bool)
                theta = np.zeros(len(names))
                for _ in range(rounds):
                    theta = np.zeros(len(names))
                    if keep.any():
                        theta[keep] = np.linalg.lstsq(phi[:, keep], slope[:, k], rcond=None)[0]
                    small = np.abs(theta) < threshold
                    if (small == ~keep).all():
                        break
                    keep = ~small
                out += [(table[KEY][0].as_py(), target, n, v) for n, v in zip(names, theta, strict=True) if v]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], ["series_id", "target", "term", "value"])

    own = states.select(F.col(KEY).cast("string").alias(KEY), "t", *[F.col(c).cast("double") for c in columns])
    return own.groupBy(KEY).applyInArrow(one, "series_id string, target string, term string, value double")


def jacobian(spark: SparkSession, expressions: dict[str, str], point: dict[str, float], step: float = 1e-5) -> DataFrame:
    """output, param, slope of expressions at a point, by central differences; expressions are checked like those of sensitivity."""
    from .simulate import safe_expression

    names = list(point)
    rows = [(p, s, *[point[q] + (s * step * max(1.0, abs(point[q])) if q == p else 0.0) for q in names]) for p in names for s in (-1, 1)]
    grid = spark.createDataFrame([(a, b, *map(float, r)) for a, b, *r in rows], "param string, side int, " + ", ".join(f"`{n}` double" for n in names))
    own = F.array(*[F.struct(F.lit(k).alias("output"), safe_expression(e, names).alias("value")) for k, e in expressions.items()])
    long = grid.select("param", "side", F.inline(own))
    wide = F.coalesce(*[F.when(F.col("param") == p, F.lit(2 * step * max(1.0, abs(v)))) for p, v in point.items()])
    return long.groupBy("output", "param").agg(F.sum(F.col("side") * F.col("value")).alias("d")).select("output", "param", (F.col("d") / wide).alias("slope"))
