"""System identification: linear and polynomial models of output from past output and input.

Fits need only sums of products of the regressors, so a series of any length is one aggregate; the
few numbers that come of it are solved for each series. What needs the rows in order (regeneration
for the bootstrap) holds one series in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import chi2_sf, normal_quantile
from . import features, order, splits
from .metrics import info_criteria
from .stats import KEY, by_time


def gram(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """n, yy, xy, xx (upper triangle by rows) of each series and key: all that least squares needs."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(KEY, *keys).agg(
        F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.array(*[F.sum(F.col(c) * F.col("y")) for c in names]).alias("xy"),
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("xx"),
    )


def _square(upper: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return out + np.triu(out, 1).T


def solve_normal(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Coefficients, residual sum of squares and covariance; None if there are too few rows or no unique solution."""
    k = len(xy)
    if n < k:
        return None
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    own = xx / np.outer(scale, scale)
    if not np.isfinite(own).all() or np.linalg.cond(own) > 1e14:
        return None
    inverse = np.linalg.inv(own)
    theta = inverse @ (xy / scale) / scale
    rss = max(0.0, yy - 2 * theta @ xy + theta @ xx @ theta)
    return theta, rss, rss / max(n - k, 1) * inverse / np.outer(scale, scale)


def _solved(names: list[str], alpha: float):
    z = normal_quantile(1 - alpha / 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                got = solve_normal(_square(np.array(r.xx, float), len(names)), np.array(r.xy, float), r.yy, r.n)
                if got:
                    theta, rss, cov = got
                    se = np.sqrt(np.maximum(np.diag(cov), 0))
                    out += [(getattr(r, KEY), r.n, rss, i, name, theta[i], theta[i] - z * se[i], theta[i] + z * se[i]) for i, name in enumerate(names)]
            yield pd.DataFrame(out, columns=[KEY, "n", "rss", "i", "name", "value", "lo", "hi"])

    return run


def least_squares(rows: DataFrame, names: list[str], alpha: float = 0.05) -> DataFrame:
    """series_id, n, rss, i, name, value, lo, hi: coefficients with normal intervals; unsolvable series are left out."""
    return gram(rows, names).mapInPandas(_solved(names, alpha), "series_id string, n long, rss double, i int, name string, value double, lo double, hi double")


def arx_names(na: int, nb: int) -> list[str]:
    return [f"y{k}" for k in range(1, na + 1)] + [f"u{k}" for k in range(nb)]


def residuals(rows: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    """series_id, t, value: what the model leaves of y; params as from least_squares."""
    theta = params.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("theta"))
    fitted = reduce(lambda a, b: a + b, [F.col(c) * F.col("theta")[i] for i, c in enumerate(names)])
    return rows.join(theta, KEY).select(KEY, F.col("t"), (F.col("y") - fitted).alias("value"))


def whiteness(rest: DataFrame, lags: int = 20, alpha: float = 0.05) -> DataFrame:
    """series_id, q, p, white: portmanteau test of residuals over min(lags, n div 5); no variance counts as white."""
    by = Window.partitionBy(KEY).orderBy("t")
    own = rest.withColumn("t", F.row_number().over(by) - 1)
    q = order.ljung_box(order.acf(own, lags), F.least(F.lit(lags), F.floor(F.col("n") / 5)).cast("int"))
    q = q.withColumn("p", F.when(F.col("q") == 0, F.lit(1.0)).otherwise(chi2_sf("q", F.col("lags").cast("double"))))
    ok = F.col("n") >= F.col("lags") + 2
    return q.select(KEY, F.when(ok, F.col("q")).otherwise(F.lit(math.nan)).alias("q"), F.when(ok, F.col("p")).otherwise(F.lit(math.nan)).alias("p"), (ok & (F.col("p") >= alpha)).alias("white"))


def fit_arx(pairs: DataFrame, na: int, nb: int, nk: int = 1, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Parameters (see least_squares; there is no constant) and one row of criteria and whiteness for each series."""
    names = arx_names(na, nb)
    rows = features.arx_regressors(pairs, na, nb, nk)
    params = least_squares(rows, names, alpha)
    return params, _summary(rows, params, names)


def _summary(rows: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    fit = params.groupBy(KEY).agg(F.max("n").alias("n"), F.max("rss").alias("rss"), F.count("*").alias("k"))
    fit = fit.select(KEY, "n", "k", "rss", *[c.alias(x) for x, c in info_criteria(F.col("n"), F.col("k"), F.col("rss")).items()])
    return fit.join(whiteness(residuals(rows, params, names)), KEY, "left")


def fit_grid(pairs: DataFrame, na: list[int], nb: list[int], nk: list[int], criterion: str = "bic") -> DataFrame:
    """series_id, na, nb, nk, criteria, whiteness, rank of all structures; each has its own number of rows."""
    out = None
    for a in na:
        for b in nb:
            for d in nk if b else nk[:1]:
                _, s = fit_arx(pairs, a, b, d)
                s = s.select(KEY, F.lit("ARX").alias("family"), F.lit(a).alias("na"), F.lit(b).alias("nb"), F.lit(d).alias("nk"), *[c for c in s.columns if c != KEY])
                out = s if out is None else out.union(s)
    return rank_structures(out, criterion)


def compare_families(pairs: DataFrame, na: list[int], nb: list[int], nk: int = 1, degree: int = 2, criterion: str = "bic") -> DataFrame:
    """series_id, family, na, nb, nk, n, k, rss, criteria, whiteness and rank of linear and polynomial models alike."""
    out = fit_grid(pairs, na, nb, [nk], criterion).drop("rank")
    for a in na:
        for b in (x for x in nb if x):
            rows = features.polynomial_basis(pairs, a, b, degree, nk)
            names = [c for c in rows.columns if c not in (KEY, "t", "y")]
            terms = fit_narmax(pairs, a, b, degree, nk)
            # Every column's coefficient, 0 for terms that were not chosen.
            every = terms.select(KEY).distinct().select(KEY, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)])))
            params = every.join(terms.select(KEY, "name", "value"), [KEY, "name"], "left").select(KEY, "i", "name", F.coalesce("value", F.lit(0.0)).alias("value"))
            rest = residuals(rows, params, names)
            size = terms.groupBy(KEY).agg(F.count("*").alias("k"))
            fit = rest.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.col("value") ** 2).alias("rss")).join(size, KEY)
            fit = fit.select(KEY, "n", "k", "rss", *[c.alias(x) for x, c in info_criteria(F.col("n"), F.col("k"), F.col("rss")).items()]).join(whiteness(rest), KEY, "left")
            out = out.union(fit.select(KEY, F.lit("NARMAX").alias("family"), F.lit(a).alias("na"), F.lit(b).alias("nb"), F.lit(nk).alias("nk"), *[c for c in fit.columns if c != KEY]))
    return rank_structures(out, criterion)


def rank_structures(fits: DataFrame, criterion: str = "bic", white_first: bool = False) -> DataFrame:
    """fits with rank by the criterion, NaN last; white_first: those with white residuals before all others."""
    first = [F.desc("white")] if white_first else []
    w = Window.partitionBy(KEY).orderBy(*first, F.isnan(criterion), criterion, "family", "na", "nb", "nk")
    return fits.withColumn("rank", F.row_number().over(w))


def frols(xx: np.ndarray, xy: np.ndarray, yy: float, threshold: float = 0.99, most: int | None = None) -> tuple[list[int], np.ndarray, list[float]]:
    """Terms chosen one by one by the share of yy that each explains beyond those before, from products alone.

    Sweeping a chosen term out of the products leaves those of what the others have beyond it.
    """
    a, b, chosen, shares = xx.astype(float).copy(), xy.astype(float).copy(), [], []
    while yy > 0 and sum(shares) < threshold and len(chosen) < (most or len(xy)):
        d = np.diag(a)
        gain = np.where(d >= 1e-14, b * b / np.where(d >= 1e-14, d, 1) / yy, -1.0)
        gain[chosen] = -1
        j = int(gain.argmax())
        if gain[j] <= 0:
            break
        chosen.append(j), shares.append(float(gain[j]))
        f = a[:, j] / a[j, j]
        b, a = b - f * b[j], a - np.outer(f, a[j])
    coefficients = np.linalg.lstsq(xx[np.ix_(chosen, chosen)], xy[chosen], rcond=None)[0] if chosen else np.zeros(0)
    return chosen, coefficients, shares


def fit_narmax(pairs: DataFrame, na: int, nb: int, degree: int = 2, nk: int = 1, threshold: float = 0.99, most: int | None = None) -> DataFrame:
    """series_id, n, i (order of choice), name, value, err: the polynomial terms that explain threshold of the output."""
    rows = features.polynomial_basis(pairs, na, nb, degree, nk)
    names = [c for c in rows.columns if c not in (KEY, "t", "y")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = []
            for r in own.itertuples(index=False):
                chosen, values, shares = frols(_square(np.array(r.xx, float), len(names)), np.array(r.xy, float), r.yy, threshold, most)
                out += [(getattr(r, KEY), r.n, i, names[j], v, s) for i, (j, v, s) in enumerate(zip(chosen, values, shares, strict=True))]
            yield pd.DataFrame(out, columns=[KEY, "n", "i", "name", "value", "err"])

    return gram(rows, names).mapInPandas(run, "series_id string, n long, i int, name string, value double, err double")


def simulate_arx(u: np.ndarray, theta: np.ndarray, na: int, nb: int, nk: int, y0: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Output regenerated from its first values, the input and the noise."""
    y, at = np.zeros(len(u)), max(na, nk + nb - 1, 1)
    y[:at] = y0[:at]
    for t in range(at, len(u)):
        y[t] = theta[:na] @ y[t - na : t][::-1] + sum(theta[na + k] * u[t - nk - k] for k in range(nb)) + noise[t]
    return y


def simulate_polynomial(u: np.ndarray, names: list[str], theta: np.ndarray, na: int, nb: int, nk: int, y0: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Output of a polynomial model regenerated from its first values; names as of features.polynomial_basis."""
    y, at = np.zeros(len(u)), max(na, nk + nb - 1, 1)
    y[:at] = y0[:at]
    factors = [[] if n == "one" else [(f[0], int(f[1:])) for f in n.split("_")] for n in names]
    for t in range(at, len(u)):
        value = noise[t]
        for own, c in zip(factors, theta, strict=True):
            term = c
            for kind, k in own:
                term *= y[t - k] if kind == "y" else u[t - nk - k]
            value += term
        y[t] = value
    return y


def _design(y: np.ndarray, u: np.ndarray, na: int, nb: int, nk: int) -> tuple[np.ndarray, np.ndarray]:
    at, n = max(na, nk + nb - 1, 1), len(y)
    cols = [y[at - k : n - k] for k in range(1, na + 1)] + [u[at - nk - k : n - nk - k] for k in range(nb)]
    return np.stack(cols, axis=1), y[at:]


def bootstrap_arx(pairs: DataFrame, na: int, nb: int, nk: int = 1, draws: int = 500, alpha: float = 0.05, seed: int = 0, parts: int = 8) -> DataFrame:
    """series_id, name, lo, hi: percentile intervals from regenerated outputs with resampled residuals.

    Draw b of a series depends on seed and b alone; draws are dealt to parts tasks.
    """
    names = arx_names(na, nb)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        y, u = table["y"].to_numpy(), table["u"].to_numpy()
        x, target = _design(y, u, na, nb, nk)
        out = []
        if len(target) > x.shape[1]:
            theta = np.linalg.lstsq(x, target, rcond=None)[0]
            rest = target - x @ theta
            rest = rest - rest.mean()
            for b in range(key[1].as_py(), draws, parts):
                rng = np.random.default_rng([seed, b])
                noise = np.r_[np.zeros(len(y) - len(rest)), rng.choice(rest, len(rest))]
                made = simulate_arx(u, theta, na, nb, nk, y, noise)
                if np.isfinite(made).all():
                    again = np.linalg.lstsq(*_design(made, u, na, nb, nk), rcond=None)[0]
                    out += [(key[0].as_py(), b, n, v) for n, v in zip(names, again, strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], ["series_id", "draw", "name", "value"])

    rows = pairs.select(F.col(KEY).cast("string").alias(KEY), F.col("t"), "y", "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    made = rows.groupBy(KEY, "part").applyInArrow(one, "series_id string, draw int, name string, value double")
    return made.groupBy(KEY, "name").agg(F.percentile("value", F.lit(alpha / 2)).alias("lo"), F.percentile("value", F.lit(1 - alpha / 2)).alias("hi"), F.count("*").alias("draws"))


def cross_validate(pairs: DataFrame, na: int, nb: int, nk: int = 1, folds: int = 5) -> DataFrame:
    """series_id, fold, n, r2, rmse of one-step predictions on blocks that follow those trained on."""
    names = arx_names(na, nb)
    roles = splits.blocked_folds(pairs, folds)
    lagged = features.arx_regressors(pairs, na, nb, nk)
    rows = lagged.join(roles.select(KEY, "t", "fold", "role"), [KEY, "t"])
    own = rows.where("role = 'train'").withColumn(KEY, F.concat_ws("\x1f", KEY, F.col("fold").cast("string")))
    params = least_squares(own, names)
    test = rows.where("role = 'test'").withColumn(KEY, F.concat_ws("\x1f", KEY, F.col("fold").cast("string")))
    e = residuals(test, params, names).join(test.select(KEY, "t", "y"), [KEY, "t"])
    m = e.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.col("value") ** 2).alias("ss"), (F.var_pop("y") * F.count("*")).alias("st"))
    part = F.split(KEY, "\x1f")
    return m.select(part[0].alias(KEY), part[1].cast("int").alias("fold"), "n", (1 - F.col("ss") / F.nullif("st", F.lit(0.0))).alias("r2"), F.sqrt(F.col("ss") / F.col("n")).alias("rmse"))


def armax(pairs: DataFrame, p: int, q: int, long: int = 20) -> DataFrame:
    """series_id, n, rss, i, name, value, lo, hi of output on p past outputs, q past innovations and the last input.

    Two regressions: a long autoregression gives the innovations, on which the model is then fitted.
    """
    first = features.arx_regressors(pairs, long, 1)
    names = arx_names(long, 1)
    e = residuals(first, least_squares(first, names), names).select(KEY, "t", F.col("value").alias("e"))
    rows = pairs.join(e, [KEY, "t"])
    cols = {f"y{k}": F.lag("y", k).over(by_time()) for k in range(1, p + 1)} | {f"e{k}": F.lag("e", k).over(by_time()) for k in range(1, q + 1)} | {"u0": F.lag("u", 1).over(by_time())}
    rows = rows.withColumns(cols).na.drop(subset=list(cols))
    return least_squares(rows, list(cols))


def armax_grid(pairs: DataFrame, p: list[int], q: list[int], criterion: str = "bic", long: int = 20) -> DataFrame:
    """series_id, family, na, nb, nk, n, k, rss, criteria and rank of all numbers of past outputs (na) and innovations (nb)."""
    out = None
    for a in p:
        for b in q:
            fit = armax(pairs, a, b, long).groupBy(KEY).agg(F.max("n").alias("n"), F.count("*").alias("k"), F.max("rss").alias("rss"))
            fit = fit.select(KEY, F.lit("ARMAX").alias("family"), F.lit(a).alias("na"), F.lit(b).alias("nb"), F.lit(1).alias("nk"), "n", "k", "rss", *[c.alias(x) for x, c in info_criteria(F.col("n"), F.col("k"), F.col("rss")).items()])
            out = fit if out is None else out.union(fit)
    return rank_structures(out, criterion)


def identifiability(pairs: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """series_id, n, snr, verdict: is there enough signal to identify anything? coherence: series_id, coherence."""
    s = order.moving_average_snr(pairs.select(KEY, "t", F.col("y").alias("value")))
    if coherence is not None:
        s = s.join(coherence.groupBy(KEY).agg(F.avg("coherence").alias("coherence")), KEY, "left")
    weak = (F.col("n") < 200) | ((F.col("n") >= 10) & (F.col("snr") < 1))
    weak = weak | F.coalesce(F.col("coherence") < 0.5, F.lit(False)) if coherence is not None else weak
    return s.withColumn("verdict", F.when(F.col("n") < 50, "NO-GO").when(weak, "MARGINAL").otherwise("GO"))


def simulator_form(params: DataFrame) -> DataFrame:
    """series_id, a, b: coefficients in the simulator's polynomial form, where past outputs change their sign."""
    part = lambda letter, sign: F.transform(F.array_sort(F.collect_list(F.when(F.col("name").startswith(letter), F.struct("i", (sign * F.col("value")).alias("v"))))), lambda x: x["v"])
    return params.groupBy(KEY).agg(part("y", -1.0).alias("a"), part("u", 1.0).alias("b"))


def best_structure(ranked: DataFrame) -> DataFrame:
    """The best structure with white residuals, else the best of all."""
    return rank_structures(ranked.drop("rank"), white_first=True).where(F.col("rank") == 1)


