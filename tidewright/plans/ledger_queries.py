"""Queries over features, splits, intervals, ledgers, screening, scope and terms. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conformal, features, ledger, metrics, review, scope, screen, splits, stats, terms
from ..sources.tables import V_DAY, V_EVID, V_MONTH, table, v_day, v_evid, v_month
from .review_queries import V_PRED, rounded, v_pred

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _features(df: DataFrame) -> DataFrame:
    """Values have eight decimals, and rounding at the sixth would often be a tie."""
    exact = [c for c in df.columns if c == "value" or c.startswith("lag_")]
    return rounded(rounded(df, 6, *[c for c, k in df.dtypes if k == "double" and c not in exact]), 9, *exact)


_W = "WINDOW w AS (PARTITION BY series_id ORDER BY t)"


@query("lag_features", f"WITH {V_MONTH} SELECT series_id, t, value, " + ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in features.LAGS) + f" FROM v_month {_W}")
def lag_features(spark, sf_dir):
    return features.lag_features(v_month(spark, sf_dir))


def _rolling(k: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY t ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN t > {k} THEN round(avg(value) OVER {frame}, 6) END AS rmean_{k}, CASE WHEN t > {k} THEN round(stddev_samp(value) OVER {frame}, 6) END AS rstd_{k}"


@query("rolling_features", f"WITH {V_MONTH} SELECT series_id, t, round(value, 9) AS value, " + ", ".join(map(_rolling, features.WINDOWS)) + " FROM v_month")
def rolling_features(spark, sf_dir):
    return _features(features.rolling_features(v_month(spark, sf_dir)))


_FOURIER = ", ".join(f"round({f}(2 * pi() * {k} * t / 12), 6) AS {f}_12_{k}" for k in (1, 2, 3) for f in ("sin", "cos"))
_CALENDAR = "CAST(t % 12 AS INTEGER) AS season_idx, CASE WHEN t % 12 < 6 THEN 0 ELSE 1 END AS season_half, t AS time_idx"


@query("calendar_fourier_features", f"WITH {V_MONTH} SELECT series_id, t, round(value, 9) AS value, {_CALENDAR}, {_FOURIER} FROM v_month")
def calendar_fourier_features(spark, sf_dir):
    return _features(features.fourier_features(features.calendar_features(v_month(spark, sf_dir), 12), 12))


@query("feature_matrix", f"WITH {V_MONTH}, f AS (SELECT series_id, t, round(value, 9) AS value, " + ", ".join(f"round(lag(value, {k}) OVER w, 9) AS lag_{k}" for k in (1, 12)) + f", {_rolling(6)}, {_CALENDAR}, {_FOURIER} FROM v_month {_W}) SELECT * FROM f WHERE t >= 12")
def feature_matrix(spark, sf_dir):
    return _features(features.feature_matrix(v_month(spark, sf_dir), 12, (1, 12), (6,)))


def _io(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = v_day(spark, sf_dir)
    y = day.where("series_id = 'ship'").select("t", F.col("value").alias("y"))
    u = day.where("series_id = 'order'").select("t", F.col("value").alias("u"))
    both = y.join(u, "t").select(F.lit("io").alias("series_id"), "t", "y", "u")
    return both.withColumn("t", F.row_number().over(stats.by_time()).cast("long") - 1)


IO = f"""{V_DAY}, io AS (SELECT 'io' AS series_id, row_number() OVER (ORDER BY a.t) - 1 AS t, a.value AS y, b.value AS u
  FROM v_day a JOIN v_day b ON a.t = b.t WHERE a.series_id = 'ship' AND b.series_id = 'order')"""


@query("arx_regressors", f"WITH {IO}, r AS (SELECT series_id, t, y, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(u, 1) OVER w AS u0, lag(u, 2) OVER w AS u1 FROM io {_W}) SELECT series_id, t, y, y1, y2, u0, u1 FROM r WHERE t >= 2")
def arx_regressors(spark, sf_dir):
    return features.arx_regressors(_io(spark, sf_dir), 2, 2)


@query("polynomial_basis", f"WITH {IO}, r AS (SELECT series_id, t, y, lag(y) OVER w AS y1, lag(u) OVER w AS u0 FROM io {_W}) SELECT series_id, t, y, 1.0::DOUBLE AS one, y1, u0, y1 * y1 AS y1_y1, y1 * u0 AS y1_u0, u0 * u0 AS u0_u0 FROM r WHERE t >= 1")
def polynomial_basis(spark, sf_dir):
    return features.polynomial_basis(_io(spark, sf_dir), 1, 1, 2)


@query("walk_forward_roles", f"""WITH {V_MONTH}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_month), f AS (SELECT *, unnest(range(5)) AS fold, greatest(1, (n - 30) // 5) AS step FROM n),
g AS (SELECT *, 30 + fold * step AS s FROM f) SELECT series_id, t, CAST(fold AS INTEGER) AS fold, CASE WHEN t < s THEN 'train' ELSE 'test' END AS role FROM g WHERE s < n AND t < s + 3""")
def walk_forward_roles(spark, sf_dir):
    return splits.walk_forward(v_month(spark, sf_dir), horizon=3).drop("value")


@query("rolling_origin_roles", f"""WITH {V_MONTH}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_month), f AS (SELECT *, unnest(range(5)) AS fold, greatest(1, (n - 30) // 5) AS step FROM n),
g AS (SELECT *, 30 + fold * step AS s FROM f) SELECT series_id, t, CAST(fold AS INTEGER) AS fold, CASE WHEN t < s THEN 'train' ELSE 'test' END AS role FROM g WHERE s < n AND t < s + 1 AND t >= s - 30""")
def rolling_origin_roles(spark, sf_dir):
    return splits.walk_forward(v_month(spark, sf_dir), expanding=False).drop("value")


_ROLES = """ro0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_month), ro1 AS (SELECT *, least(12, greatest(1, n // 5)) AS test FROM ro0),
ro2 AS (SELECT *, greatest(1, (n - test) // 5) AS calib FROM ro1), ro AS (SELECT series_id, t, value, CASE WHEN t < n - test - calib THEN 'train' WHEN t < n - test THEN 'calib' ELSE 'test' END AS role FROM ro2)"""


@query("train_calib_test", f"WITH {V_MONTH}, {_ROLES} SELECT series_id, t, role FROM ro")
def train_calib_test(spark, sf_dir):
    return splits.train_calib_test(v_month(spark, sf_dir), 12).drop("value")


@query("blocked_folds", f"""WITH {V_MONTH}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_month), f AS (SELECT *, unnest(range(5)) AS fold, n // 6 AS size FROM n)
SELECT series_id, t, CAST(fold AS INTEGER) AS fold, CASE WHEN t < (fold + 2) * size THEN 'train' ELSE 'test' END AS role FROM f WHERE t < (fold + 3) * size AND least((fold + 3) * size, n) - (fold + 2) * size >= 3 AND size >= 5""")
def blocked_folds(spark, sf_dir):
    return splits.blocked_folds(v_month(spark, sf_dir)).drop("value")


def _threshold(view: str, score: str, by: str = "series_id") -> str:
    return f"""th0 AS (SELECT {by}, {score} AS score, row_number() OVER (PARTITION BY {by} ORDER BY {score}) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {view}),
th AS (SELECT {by}, max(score) FILTER (k = greatest(1, least(CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT), n))) AS threshold, bool_and(CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT) <= n) AS ok FROM th0 GROUP BY 1)"""


@query("conformal", f"""WITH {V_PRED}, c AS (SELECT series_id, abs(actual - predicted) AS score FROM v_pred WHERE model = 'seasonal' AND t < 60), {_threshold('c', 'score')}
SELECT v.series_id, t AS h, round(predicted, 9) AS yhat, round(predicted - threshold, 9) AS lo, round(predicted + threshold, 9) AS hi, ok AS guarantee_ok FROM v_pred v JOIN th USING (series_id) WHERE model = 'seasonal' AND t >= 60""")
def conformal_intervals(spark, sf_dir):
    p = v_pred(spark, sf_dir).where("model = 'seasonal'")
    rest = p.where("t < 60").select("series_id", (F.col("actual") - F.col("predicted")).alias("residual"))
    return rounded(conformal.intervals(rest, p.where("t >= 60").select("series_id", F.col("t").alias("h"), F.col("predicted").alias("yhat")), 0.9), 9)


@query("cqr", f"""WITH {V_PRED}, q AS (SELECT series_id, t, actual, predicted * 0.9 AS lo, predicted * 1.1 AS hi FROM v_pred WHERE model = 'seasonal'), c AS (SELECT series_id, greatest(lo - actual, actual - hi) AS score FROM q WHERE t < 60), {_threshold('c', 'score')},
m AS (SELECT q.series_id, t, lo - threshold AS a, hi + threshold AS b FROM q JOIN th USING (series_id) WHERE t >= 60)
SELECT series_id, t, round(CASE WHEN a > b THEN (a + b) / 2 ELSE a END, 6) AS lo, round(CASE WHEN a > b THEN (a + b) / 2 ELSE b END, 6) AS hi FROM m""")
def cqr_intervals(spark, sf_dir):
    q = v_pred(spark, sf_dir).where("model = 'seasonal'").select("series_id", "t", "actual", (F.col("predicted") * 0.9).alias("lo"), (F.col("predicted") * 1.1).alias("hi"))
    return rounded(conformal.cqr(q.where("t < 60"), q.where("t >= 60").drop("actual"), 0.9))


@query("interval_quality", f"""WITH {V_PRED}, q AS (SELECT series_id, model, actual, predicted * 0.8 AS lo, predicted * 1.2 AS hi FROM v_pred),
a AS (SELECT series_id, model, count(*) AS n, avg((actual BETWEEN lo AND hi)::INTEGER) AS coverage, avg(hi - lo) AS mean_width, max(actual) - min(actual) AS range, stddev_samp(hi - lo) AS s,
  avg(hi - lo + CASE WHEN actual < lo THEN 2 / (1 - 0.95::DOUBLE) * (lo - actual) WHEN actual > hi THEN 2 / (1 - 0.95::DOUBLE) * (actual - hi) ELSE 0 END) AS winkler FROM q GROUP BY 1, 2)
SELECT series_id, model, n, {_r('coverage', 'mean_width')}, round(mean_width / range, 6) AS relative_width, round(s / mean_width, 6) AS width_cv, {_r('winkler')} FROM a""")
def interval_quality(spark, sf_dir):
    q = v_pred(spark, sf_dir).withColumns({"lo": F.col("predicted") * 0.8, "hi": F.col("predicted") * 1.2})
    return rounded(metrics.interval_quality(q, 0.95, "model"))


@query("residual_diagnostics", f"""WITH {V_PRED}, r AS (SELECT series_id, t - 12 AS t, actual - predicted AS value FROM v_pred WHERE model = 'naive'),
n AS (SELECT series_id, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM r GROUP BY 1), x AS (SELECT series_id, t, n, value - m AS x FROM r JOIN n USING (series_id)), v AS (SELECT series_id, sum(x * x) AS v FROM x GROUP BY 1),
a AS (SELECT a.series_id, a.t - b.t AS lag, max(a.n) AS n, sum(a.x * b.x) AS s FROM x a JOIN x b ON a.series_id = b.series_id AND a.t - b.t BETWEEN 1 AND least(20, a.n // 3) GROUP BY 1, 2),
c AS (SELECT series_id, count(*) FILTER (abs(s / v) > 2 / sqrt(n)) AS c FROM a JOIN v USING (series_id) GROUP BY 1),
h AS (SELECT r.series_id, greatest(coalesce(stddev_samp(value) FILTER (t < n // 2), 0), 1e-12) / greatest(coalesce(stddev_samp(value) FILTER (t >= n // 2), 0), 1e-12) AS h FROM r JOIN n ON r.series_id = n.series_id GROUP BY 1),
f AS (SELECT series_id, n, CASE WHEN s > 0 THEN abs(m) / (s / sqrt(n)) ELSE 'inf'::DOUBLE END AS b, CAST(c AS DOUBLE) AS c, h FROM n JOIN c USING (series_id) JOIN h USING (series_id)),
g AS (SELECT series_id, 'residual_bias' AS "check", CASE WHEN b > 2.576 THEN 'FAIL' WHEN b > 1.96 THEN 'WARN' ELSE 'PASS' END AS verdict, CASE WHEN b > 2.576 THEN 'HIGH' WHEN b > 1.96 THEN 'MEDIUM' ELSE 'INFO' END AS severity, b AS value FROM f WHERE n >= 10
UNION ALL SELECT series_id, 'residual_acf', CASE WHEN c > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN c > 0 THEN 'HIGH' ELSE 'INFO' END, c FROM f WHERE n >= 10
UNION ALL SELECT series_id, 'residual_heteroscedasticity', CASE WHEN h > 2 OR h < 0.5 THEN 'WARN' ELSE 'PASS' END, CASE WHEN h > 2 OR h < 0.5 THEN 'MEDIUM' ELSE 'INFO' END, h FROM f WHERE n >= 10
UNION ALL SELECT series_id, 'residuals', 'SKIP', 'INFO', NULL FROM f WHERE n < 10)
SELECT series_id, 8 AS phase_no, 'residuals' AS phase, "check", verdict, severity, round(value, 6) AS value FROM g""")
def residual_diagnostics(spark, sf_dir):
    rest = v_pred(spark, sf_dir).where("model = 'naive'").select("series_id", (F.col("t") - 12).alias("t"), (F.col("actual") - F.col("predicted")).alias("value"))
    return rounded(review.residuals(rest))


@query("overfit_screen", f"""WITH {V_PRED}, m AS (SELECT series_id, CASE WHEN t < 60 THEN 'train' ELSE 'test' END AS split, count(*) AS n, 1 - sum(power(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - predicted)) AS mae FROM v_pred WHERE model = 'naive' GROUP BY 1, 2),
s AS (SELECT a.series_id, a.r2 AS r, b.r2 AS tr, a.mae / b.mae AS more FROM m a JOIN m b ON a.series_id = b.series_id AND a.split = 'test' AND b.split = 'train'),
f AS (SELECT series_id, 'test_r2' AS "check", CASE WHEN r > 0.99 THEN 'REJECT' WHEN r > 0.95 OR r < 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN r > 0.99 THEN 'CRITICAL' WHEN r > 0.95 OR r < 0 THEN 'HIGH' ELSE 'INFO' END AS severity, r AS value FROM s
UNION ALL SELECT series_id, 'train_r2_memorization', 'REJECT', 'CRITICAL', tr FROM s WHERE tr >= 0.9999 UNION ALL SELECT series_id, 'train_r2', 'WARN', 'HIGH', tr FROM s WHERE tr > 0.99 AND tr < 0.9999
UNION ALL SELECT series_id, 'test_better_than_train', 'REJECT', 'CRITICAL', r FROM s WHERE r > tr + 0.01
UNION ALL SELECT series_id, 'overfit_gap', CASE WHEN tr - r > 0.3 THEN 'FAIL' WHEN tr - r > 0.15 THEN 'WARN' ELSE 'PASS' END, CASE WHEN tr - r > 0.3 THEN 'HIGH' WHEN tr - r > 0.15 THEN 'MEDIUM' ELSE 'INFO' END, tr - r FROM s
UNION ALL SELECT series_id, 'mae_gap', CASE WHEN more > 3 THEN 'FAIL' WHEN more > 1.5 THEN 'WARN' ELSE 'PASS' END, CASE WHEN more > 3 THEN 'HIGH' WHEN more > 1.5 THEN 'MEDIUM' ELSE 'INFO' END, more FROM s)
SELECT series_id, 7 AS phase_no, 'overfitting' AS phase, "check", verdict, severity, round(value, 6) AS value FROM f""")
def overfit_screen(spark, sf_dir):
    p = v_pred(spark, sf_dir).where("model = 'naive'").withColumn("split", F.when(F.col("t") < 60, "train").otherwise("test"))
    return rounded(review.overfitting(p))


@query("uncertainty_findings", f"""WITH {V_PRED}, q AS (SELECT series_id, actual AS a, predicted * 0.8 AS lo, predicted * 1.2 AS hi FROM v_pred WHERE model = 'seasonal'),
s AS (SELECT series_id, count(*) AS n, avg(CASE WHEN a BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS c, avg(hi - lo) / (max(a) - min(a)) AS w, stddev_samp(hi - lo) / avg(hi - lo) AS v, avg(hi - lo + CASE WHEN a < lo THEN 2 / 0.05::DOUBLE * (lo - a) WHEN a > hi THEN 2 / 0.05::DOUBLE * (a - hi) ELSE 0 END) AS k FROM q GROUP BY 1),
g AS (SELECT series_id, 'coverage' AS "check", CASE WHEN c - 0.95 < -0.10 THEN 'FAIL' WHEN c - 0.95 < -0.03 OR c - 0.95 > 0.10 THEN 'WARN' ELSE 'PASS' END AS verdict, CASE WHEN c - 0.95 < -0.10 THEN 'HIGH' WHEN c - 0.95 < -0.03 THEN 'MEDIUM' WHEN c - 0.95 > 0.10 THEN 'LOW' ELSE 'INFO' END AS severity, c AS value FROM s WHERE n >= 10
UNION ALL SELECT series_id, 'interval_width', CASE WHEN w > 1 THEN 'WARN' ELSE 'PASS' END, CASE WHEN w > 1 THEN 'MEDIUM' ELSE 'INFO' END, w FROM s WHERE n >= 10
UNION ALL SELECT series_id, 'interval_consistency', CASE WHEN v > 0.5 THEN 'WARN' ELSE 'PASS' END, CASE WHEN v > 0.5 THEN 'LOW' ELSE 'INFO' END, v FROM s WHERE n >= 20
UNION ALL SELECT series_id, 'winkler_score', 'PASS', 'INFO', k FROM s WHERE n >= 10 UNION ALL SELECT series_id, 'uncertainty', 'SKIP', 'INFO', NULL FROM s WHERE n < 10)
SELECT series_id, 9 AS phase_no, 'uncertainty' AS phase, "check", verdict, severity, round(value, 6) AS value FROM g""")
def uncertainty_findings(spark, sf_dir):
    q = v_pred(spark, sf_dir).where("model = 'seasonal'").withColumns({"lo": F.col("predicted") * 0.8, "hi": F.col("predicted") * 1.2})
    return rounded(review.uncertainty(q))


# --- ledgers ----------------------------------------------------------------------------------


def _fold(prior: float, bands: tuple[float, float, float], key: str = "hid", view: str = "v_evid") -> str:
    up, down, weak = bands
    p = "greatest(0.001, least(0.999, a.p))"
    after = f"(CASE WHEN x.lr = 0 THEN 0.001 ELSE greatest(0.001, least(0.999, {p} / (1 - {p}) * x.lr / (1 + {p} / (1 - {p}) * x.lr))) END)"
    return f"""fo0 AS (SELECT {key}, list(likelihood_ratio ORDER BY seq) AS l, count(*) AS n FROM {view} GROUP BY 1),
fo1 AS (SELECT {key}, n, list_reduce(list_transform(l, lambda r: struct_pack(p := 0.0::DOUBLE, lr := r, c := false, k := 0)),
  lambda a, x: CASE WHEN a.c THEN a ELSE struct_pack(p := {after}::DOUBLE, lr := x.lr, c := {after} <= {down}, k := a.k + 1) END, struct_pack(p := {prior}::DOUBLE, lr := 1.0::DOUBLE, c := false, k := 0)) AS e FROM fo0),
fo AS (SELECT {key}, n, e.k AS k, e.p AS posterior, CASE WHEN e.p >= {up} THEN 'CONFIRMED' WHEN e.p <= {down} THEN 'REFUTED' WHEN e.p <= {weak} THEN 'WEAKENED' ELSE 'ACTIVE' END AS status FROM fo1)"""


@query("bayes_fold", f"WITH {V_EVID}, {_fold(0.5, ledger.HYPOTHESIS_BANDS)} SELECT hid, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS applied_n, CAST(n - k AS INTEGER) AS rejected_n, 0.5::DOUBLE AS prior, round(posterior, 6) AS posterior, status FROM fo")
def bayes_fold(spark, sf_dir):
    return rounded(ledger.fold(v_evid(spark, sf_dir)).drop("history"))


@query("trait_fold", f"WITH {V_EVID}, {_fold(0.4, ledger.TRAIT_BANDS)} SELECT hid, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS applied_n, CAST(n - k AS INTEGER) AS rejected_n, 0.4::DOUBLE AS prior, round(posterior, 6) AS posterior, status FROM fo")
def trait_fold(spark, sf_dir):
    return rounded(ledger.fold(v_evid(spark, sf_dir), 0.4, ledger.TRAIT_BANDS).drop("history"))


@query("hypothesis_status", f"WITH {V_EVID}, {_fold(0.5, ledger.HYPOTHESIS_BANDS)} SELECT status, count(*) AS n, round(avg(posterior), 6) AS mean_posterior FROM fo GROUP BY 1")
def hypothesis_status(spark, sf_dir):
    return rounded(ledger.fold(v_evid(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.avg("posterior").alias("mean_posterior")))


@query("compare_hypotheses", f"""WITH {V_EVID}, {_fold(0.5, ledger.HYPOTHESIS_BANDS)}, c AS (SELECT a.hid % 50 AS grp, a.hid AS h1, b.hid AS h2, a.posterior / b.posterior AS k FROM fo a JOIN fo b ON a.hid % 50 = b.hid % 50 AND a.hid < b.hid)
SELECT grp, h1, h2, round(k, 6) AS posterior_ratio, round(log10(k), 6) AS log10_ratio, CASE WHEN log10(k) > 2 THEN 'decisive for h1' WHEN log10(k) > 1 THEN 'strong for h1' WHEN log10(k) > 0.5 THEN 'substantial for h1' WHEN log10(k) > -0.5 THEN 'barely worth mentioning'
  WHEN log10(k) > -1 THEN 'substantial for h2' WHEN log10(k) > -2 THEN 'strong for h2' ELSE 'decisive for h2' END AS interpretation FROM c""")
def compare_hypotheses(spark, sf_dir):
    return rounded(ledger.compare(ledger.fold(v_evid(spark, sf_dir)).withColumn("grp", F.col("hid") % 50)))


_TRAITS = f"""{_fold(0.4, ledger.TRAIT_BANDS)}, tr AS (SELECT hid // 8 AS subject, ['openness', 'conscientiousness', 'extraversion', 'agreeableness', 'neuroticism', 'narcissism', 'machiavellianism', 'psychopathy'][1 + hid % 7] AS category, hid AS id,
  CASE WHEN hid % 3 = 0 THEN 'low' ELSE 'high' END AS polarity, posterior, status FROM fo)"""


def _traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, (*ledger.OCEAN, *ledger.DARK_TRIAD)))
    f = ledger.fold(v_evid(spark, sf_dir), 0.4, ledger.TRAIT_BANDS)
    return f.select(F.floor(F.col("hid") / 8).alias("subject"), F.get(names, (F.col("hid") % 7).cast("int")).alias("category"), F.col("hid").alias("id"), F.when(F.col("hid") % 3 == 0, "low").otherwise("high").alias("polarity"), "posterior", "status")


def _profile_sql(categories) -> str:
    return f"""pr AS (SELECT s.subject, c.category, coalesce(b.polarity, 'unknown') AS level, coalesce(b.posterior, 0.0) AS confidence, CASE WHEN b.status IS NOT NULL THEN b.status WHEN x.n IS NULL THEN 'UNASSESSED' ELSE 'REFUTED' END AS status
  FROM (SELECT DISTINCT subject FROM tr) s CROSS JOIN (SELECT unnest({list(categories)}) AS category) c
  LEFT JOIN (SELECT subject, category, count(*) AS n FROM tr GROUP BY 1, 2) x ON x.subject = s.subject AND x.category = c.category
  LEFT JOIN (SELECT * FROM tr WHERE status <> 'REFUTED' QUALIFY row_number() OVER (PARTITION BY subject, category ORDER BY posterior DESC, id) = 1) b ON b.subject = s.subject AND b.category = c.category)"""


@query("trait_profile", f"WITH {V_EVID}, {_TRAITS}, {_profile_sql(ledger.OCEAN)} SELECT subject, category, level, round(confidence, 6) AS confidence, status FROM pr")
def trait_profile(spark, sf_dir):
    return rounded(ledger.profile(_traits(spark, sf_dir), ledger.OCEAN, "subject"))


@query("dt_risk", f"WITH {V_EVID}, {_TRAITS}, {_profile_sql(ledger.DARK_TRIAD)} SELECT subject, round(sum(CASE category WHEN 'machiavellianism' THEN 0.4 ELSE 0.3 END * CASE level WHEN 'unknown' THEN 0 WHEN 'high' THEN confidence ELSE 1 - confidence END), 6) AS risk FROM pr GROUP BY 1")
def dt_risk(spark, sf_dir):
    return rounded(ledger.dark_triad_risk(ledger.profile(_traits(spark, sf_dir), tuple(ledger.DARK_TRIAD), "subject"), "subject"))


@query("overall_confidence", f"WITH {V_EVID}, {_TRAITS}, c AS (SELECT subject, avg(abs(posterior - 0.5) * 2) AS c FROM tr GROUP BY 1) SELECT subject, round(c, 6) AS confidence, CASE WHEN c > 0.7 THEN 'High' WHEN c > 0.4 THEN 'Medium' ELSE 'Low' END AS label FROM c")
def overall_confidence(spark, sf_dir):
    return rounded(ledger.overall_confidence(_traits(spark, sf_dir), "subject"))


# --- screening --------------------------------------------------------------------------------

_CATEGORIES = screen.FLAG_CATEGORIES


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of low quality or toxic as flags on their source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    f = table(spark, sf_dir, "labels").join(d, "doc_id").where("quality = 0 or toxic = 1")
    cat = F.get(F.array(*map(F.lit, _CATEGORIES[:5])), (F.col("doc_id") % 5).cast("int"))
    severity = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 7 == 0), "critical").when(F.col("toxic") == 1, "major").otherwise("minor")
    return f.select(F.col("source").alias("subject"), "doc_id", cat.alias("category"), severity.alias("severity"))


V_FLAGS = f"""v_flags AS (SELECT d.source AS subject, l.doc_id, {list(_CATEGORIES[:5])}[1 + l.doc_id % 5] AS category,
  CASE WHEN toxic = 1 AND l.doc_id % 7 = 0 THEN 'critical' WHEN toxic = 1 THEN 'major' ELSE 'minor' END AS severity FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0 OR toxic = 1)"""


@query("flag_counts", f"""WITH {V_FLAGS} SELECT s.subject, 'category' AS kind, c.name, coalesce(n, 0) AS n FROM (SELECT DISTINCT subject FROM v_flags) s CROSS JOIN (SELECT unnest({list(_CATEGORIES)}) AS name) c
  LEFT JOIN (SELECT subject, category, count(*) AS n FROM v_flags GROUP BY 1, 2) f ON f.subject = s.subject AND f.category = c.name
UNION ALL SELECT subject, 'severity', severity, count(*) FROM v_flags GROUP BY 1, 3 UNION ALL SELECT subject, 'total', 'all', count(*) FROM v_flags GROUP BY 1""")
def flag_counts(spark, sf_dir):
    return screen.flag_counts(_flags(spark, sf_dir), _CATEGORIES, "subject")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("subject"), F.col("lang").alias("check_type"), F.col("doc_id").alias("seq"), F.when(F.col("n_chars") % 11 == 0, "FAIL").otherwise("PASS").alias("status"))


_CHECKS = """ck AS (SELECT source AS subject, lang AS check_type, CASE WHEN arg_max(n_chars, doc_id) % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM documents GROUP BY 1, 2)"""


@query("coherence_summary", f"WITH {_CHECKS} SELECT subject, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) = count(*) FILTER (status = 'PASS') AS all_passed FROM ck GROUP BY 1")
def coherence_summary(spark, sf_dir):
    return screen.coherence_summary(_checks(spark, sf_dir), "subject")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts and taxes of lines as metric values."""
    rows = table(spark, sf_dir, "lineitem")
    kinds = (("ml_classification", "accuracy", 1 - F.col("l_discount")), ("time_series", "mape", F.col("l_tax") + 0.001), ("financial_prediction", "max_drawdown", F.col("l_discount") * 6), ("medical", "unheard_of", F.col("l_tax")))
    own = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(m).alias("metric"), v.alias("value")) for d, m, v in kinds])
    return rows.select(F.col("l_returnflag").alias("subject"), F.inline(own))


_BOUNDS = "bounds(domain, metric, suspicious, lo, hi, excellent) AS (VALUES " + ", ".join(f"('{d}', '{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for d, m, a, b, c, e in screen.BOUNDS) + ")"
_ASSESSED = f"""{_BOUNDS}, vals AS (SELECT l_returnflag AS subject, 'ml_classification' AS domain, 'accuracy' AS metric, 1 - l_discount AS value FROM lineitem UNION ALL SELECT l_returnflag, 'time_series', 'mape', l_tax + 0.001::DOUBLE FROM lineitem
  UNION ALL SELECT l_returnflag, 'financial_prediction', 'max_drawdown', l_discount * 6 FROM lineitem UNION ALL SELECT l_returnflag, 'medical', 'unheard_of', l_tax FROM lineitem),
assessed AS (SELECT v.*, CASE WHEN suspicious IS NULL THEN 'unknown' WHEN suspicious < excellent THEN CASE WHEN value <= suspicious THEN 'suspicious' WHEN value <= excellent THEN 'excellent' WHEN value <= hi THEN 'plausible' WHEN value <= lo THEN 'plausible_poor' ELSE 'implausible' END
  ELSE CASE WHEN value >= suspicious THEN 'suspicious' WHEN value >= excellent THEN 'excellent' WHEN value >= hi THEN 'plausible' WHEN value >= lo THEN 'plausible_poor' ELSE 'implausible' END END AS assessment FROM vals v LEFT JOIN bounds b ON v.domain = b.domain AND v.metric = b.metric)"""


@query("calibrate_bounds", f"WITH {_ASSESSED} SELECT subject, domain, metric, assessment, count(*) AS n FROM assessed GROUP BY 1, 2, 3, 4")
def calibrate_bounds(spark, sf_dir):
    return screen.calibrate(_values(spark, sf_dir)).groupBy("subject", "domain", "metric", "assessment").agg(F.count("*").alias("n"))


@query("verdict_ladder", f"""WITH {V_FLAGS}, {_CHECKS}, f AS (SELECT subject, count(*) AS n, count(DISTINCT category) AS c, count(*) FILTER (severity = 'critical') AS x FROM v_flags GROUP BY 1),
k AS (SELECT subject, count(*) FILTER (status = 'FAIL') AS failed FROM ck GROUP BY 1), s AS (SELECT DISTINCT source AS subject FROM documents),
v AS (SELECT s.subject, coalesce(n, 0) AS total_flags, coalesce(c, 0) AS categories, coalesce(x, 0) AS critical, coalesce(failed, 0) AS failed, 0::BIGINT AS suspicious FROM s LEFT JOIN f USING (subject) LEFT JOIN k USING (subject))
SELECT *, CASE WHEN critical > 0 OR failed > 0 OR total_flags > 5 OR categories >= 4 THEN 'REJECT' WHEN total_flags >= 4 OR categories >= 3 THEN 'DOUBTFUL' WHEN total_flags >= 2 THEN 'SKEPTICAL' ELSE 'CREDIBLE' END AS verdict FROM v""")
def verdict_ladder(spark, sf_dir):
    subjects = table(spark, sf_dir, "documents").select(F.col("source").alias("subject")).distinct()
    return screen.verdict(subjects, _flags(spark, sf_dir), _checks(spark, sf_dir))


# --- scope, abduction, terms ------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    domain = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(""))
    return p.select(F.col("p_partkey").alias("seq"), domain.alias("domain"), F.col("p_type").alias("mechanism"))


@query("dedupe_candidates", """WITH c AS (SELECT p_partkey AS seq, (CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END) || CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE '' END AS domain, p_type AS mechanism FROM part)
SELECT seq, domain, mechanism FROM c QUALIFY row_number() OVER (PARTITION BY lower(trim(domain)) ORDER BY seq) = 1""")
def dedupe_candidates(spark, sf_dir):
    return scope.dedupe(_candidates(spark, sf_dir))


_ARCH = "arch(archetype_id, domain, mechanism, prior, signature) AS (VALUES " + ", ".join(f"('{a}', '{d}', '{m}', {p}::DOUBLE, '{s}')" for a, d, m, p, s in scope.ARCHETYPES) + ")"
_TRACE = "trace(category, cause, mechanism, prior, complexity) AS (VALUES " + ", ".join(f"('{a}', '{c}', '{m}', {p}::DOUBLE, {x}::DOUBLE)" for a, c, m, p, x in scope.TRACES) + ")"


@query("enumerate_archetype", f"WITH {_ARCH}, q AS (SELECT c_custkey AS audit, ['thin_market', 'hosted_service', 'organisation', 'unknown'][1 + c_custkey % 4] AS archetype_id FROM customer) SELECT audit, archetype_id, domain, mechanism, prior FROM q JOIN arch USING (archetype_id)")
def enumerate_archetype(spark, sf_dir):
    names = F.array(*map(F.lit, ("thin_market", "hosted_service", "organisation", "unknown")))
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("audit"), F.get(names, (F.col("c_custkey") % 4).cast("int")).alias("archetype_id"))
    return scope.enumerate_archetype(q, scope.archetypes(spark))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("timing", "failure", "unheard_of", "output_anomaly")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obs_id"), F.get(names, (F.col("c_custkey") % 4).cast("int")).alias("category"))


_OBS = "obs AS (SELECT c_custkey AS obs_id, ['timing', 'failure', 'unheard_of', 'output_anomaly'][1 + c_custkey % 4] AS category FROM customer)"


@query("trace_inversion", f"WITH {_TRACE}, {_OBS} SELECT obs_id, cause, prior, 'library' AS source, complexity FROM (SELECT obs_id, CASE WHEN category IN (SELECT category FROM trace) THEN category ELSE 'generic' END AS category FROM obs) JOIN trace USING (category)")
def trace_inversion(spark, sf_dir):
    return scope.invert(_observations(spark, sf_dir), scope.traces(spark))


def _explains(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 40).alias("cand_id"), F.col("o_custkey").alias("obs_id"))


_EXPLAINS = "ex AS (SELECT o_orderkey % 40 AS cand_id, o_custkey AS obs_id FROM orders WHERE o_orderstatus = 'F')"


@query("surplus_audit", f"WITH {_OBS}, {_EXPLAINS} SELECT obs_id, category FROM obs WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.obs_id = obs.obs_id)")
def surplus_audit(spark, sf_dir):
    return scope.surplus(_observations(spark, sf_dir), _explains(spark, sf_dir)).select("obs_id", "category")


@query("coverage_promotion", f"""WITH {_EXPLAINS}, c AS (SELECT n_nationkey AS cand_id, n_name AS cause, 0.1::DOUBLE + n_nationkey * 0.02::DOUBLE AS prior, CASE WHEN n_nationkey % 2 = 0 THEN 'library' ELSE 'llm_parametric' END AS source, 0.05::DOUBLE + 0.01::DOUBLE * n_regionkey AS complexity FROM nation),
s AS (SELECT c.*, coalesce((SELECT count(DISTINCT obs_id) FROM ex WHERE ex.cand_id = c.cand_id), 0) / (SELECT count(*) FROM customer) / complexity AS coverage_score FROM c)
SELECT cand_id, cause, round(prior, 6) AS prior, source, round(coverage_score, 6) AS coverage_score, coverage_score >= 0.3 AND NOT (source = 'llm_parametric' AND prior > 0.3) AS promoted FROM s""")
def coverage_promotion(spark, sf_dir):
    k = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(k.alias("cand_id"), F.col("n_name").alias("cause"), (0.1 + k * 0.02).alias("prior"), F.when(k % 2 == 0, "library").otherwise("llm_parametric").alias("source"), (0.05 + 0.01 * F.col("n_regionkey")).alias("complexity"), F.lit(False).alias("promoted"))
    scored = scope.coverage(c, _explains(spark, sf_dir), _observations(spark, sf_dir))
    won = scope.promote(scored).select("cand_id", F.lit(True).alias("won"))
    return rounded(scored.join(won, "cand_id", "left").select("cand_id", "cause", "prior", "source", "coverage_score", F.coalesce("won", F.lit(False)).alias("promoted")))


@query("residual_match", f"""WITH {V_DAY}, {V_MONTH}, res AS (SELECT t, value FROM v_day WHERE series_id = 'ship'), ix AS (SELECT 'orders' AS name, t, value FROM v_day WHERE series_id = 'order' UNION ALL SELECT 'double', t, 2 * value FROM res UNION ALL SELECT 'constant', t, 1.0 FROM res)
SELECT name AS index, count(*) AS n, round(coalesce(covar_pop(r.value, i.value) / nullif(stddev_pop(r.value) * stddev_pop(i.value), 0), 0), 6) AS r FROM ix i JOIN res r USING (t) GROUP BY 1""")
def residual_match(spark, sf_dir):
    day = v_day(spark, sf_dir)
    res = day.where("series_id = 'ship'").select("t", "value")
    ix = day.where("series_id = 'order'").select(F.lit("orders").alias("name"), "t", "value").union(res.select(F.lit("double"), "t", 2 * F.col("value"))).union(res.select(F.lit("constant"), "t", F.lit(1.0)))
    return rounded(scope.residual_match(res, ix).select("index", "n", "r"))


@query("jaccard_retrieval", f"""WITH {_ARCH}, q AS (SELECT o_orderkey AS query_id, list_distinct(list_filter(string_split_regex(lower(replace(['prices move, demand', 'Latency steps when calls repeat', 'results cluster at round values', 'nothing in common'][1 + o_orderkey % 4], ',', ' ')), '\\s+'), lambda x: x <> '')) AS a FROM orders),
s AS (SELECT archetype_id, signature, list_distinct(string_split(signature, ' ')) AS b FROM arch), p AS (SELECT query_id, archetype_id, signature, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM q, s),
z AS (SELECT * FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, archetype_id ORDER BY score DESC, signature) = 1)
SELECT query_id, archetype_id, signature, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, archetype_id) AS INTEGER) AS rank FROM z""")
def jaccard_retrieval(spark, sf_dir):
    said = F.array(*map(F.lit, ("prices move, demand", "Latency steps when calls repeat", "results cluster at round values", "nothing in common")))
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.get(said, (F.col("o_orderkey") % 4).cast("int")).alias("text"))
    return rounded(scope.analogize(q, scope.archetypes(spark)))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    lr = F.when(F.col("l_discount") > 0.095, 0.0).otherwise(0.5 + F.col("l_discount") * 20)
    refs = F.when(F.col("l_quantity") > 2, F.array(F.col("l_partkey").cast("string")))
    return rows.select(F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("idx"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), lr.alias("lr"), refs.alias("refs"))


_STEP = "CASE WHEN x <= 0 THEN 0.001 ELSE greatest(0.001, least(0.999, greatest(0.001, least(0.999, p)) / (1 - greatest(0.001, least(0.999, p))) * x / (1 + greatest(0.001, least(0.999, p)) / (1 - greatest(0.001, least(0.999, p))) * x))) END"


@query("chain_close", f"""WITH s AS (SELECT o_custkey AS chain_id, list(CASE WHEN o_orderpriority LIKE '5%' THEN 0.8 WHEN o_orderpriority LIKE '1%' THEN 1.4 ELSE 1.05 END::DOUBLE ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
SELECT chain_id, CAST(len(l) AS INTEGER) AS n_steps, round(list_reduce(l, lambda p, x: {_STEP}, 0.5::DOUBLE), 6) AS final_posterior FROM s""")
def chain_close(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lr = F.when(F.col("o_orderpriority").startswith("5"), 0.8).when(F.col("o_orderpriority").startswith("1"), 1.4).otherwise(1.05)
    return rounded(ledger.chain_close(o.select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("idx"), lr.alias("lr"))))


@query("chain_audit", """WITH s AS (SELECT l_orderkey AS chain_id, l_linenumber AS idx, CASE WHEN l_discount > 0.095 THEN 0.0 ELSE 0.5 + l_discount * 20 END AS lr, l_quantity > 2 AS refs, row_number() OVER w AS place, lead(1) OVER w IS NOT NULL AS more
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT chain_id, 'order:' || place AS gap FROM s WHERE idx <> place UNION ALL SELECT chain_id, 'references:' || place FROM s WHERE NOT refs UNION ALL SELECT chain_id, 'falsified:' || place FROM s WHERE lr = 0 AND more
UNION ALL SELECT o_orderkey, 'short' FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND coalesce(n, 0) < 2""")
def chain_audit(spark, sf_dir):
    chains = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    return ledger.chain_audit(_steps(spark, sf_dir), chains)


@query("extract_terms", """WITH d AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g') AS text FROM documents),
h AS (SELECT doc_id, p, unnest(l) AS term, unnest(range(len(l))) AS i FROM (SELECT doc_id, 0 AS p, regexp_extract_all(text, '\\b[A-Z]{2,}\\b') AS l FROM d
  UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '\\b[A-Za-z]+\\d+[A-Za-z\\d]*\\b') FROM d UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2}\\b') FROM d))
SELECT lower(trim(term)) AS key, arg_min(trim(term), (p, doc_id, i)) AS text, count(*) AS frequency FROM h GROUP BY 1""")
def extract_terms(spark, sf_dir):
    return terms.extract(table(spark, sf_dir, "documents"))


@query("gates", f"""WITH {_EXPLAINS}, {_OBS}, a AS (SELECT count(*) AS n FROM obs WHERE obs_id IN (SELECT obs_id FROM ex)),
s AS (SELECT s_nationkey AS subject, count(*) AS grounded, count(*) FILTER (s_suppkey % 3 = 0) AS library, count(*) FILTER (s_acctbal > 5000) AS metrics_promoted, count(*) FILTER (s_acctbal < 0) AS aliases, count(*) FILTER (s_acctbal > 0) AS verified, 1::BIGINT AS candidates FROM supplier GROUP BY 1)
SELECT 'abduction' AS gate, -1 AS subject, n >= 3 AS pass, CASE WHEN n < 3 THEN 1 ELSE 0 END + CASE WHEN n = 0 THEN 1 ELSE 0 END AS failures FROM a UNION ALL
SELECT 'domain', subject, grounded >= 10 AND library / grounded >= 0.3 AND metrics_promoted >= 3 AND verified >= 2 AND aliases > 0,
  (grounded < 10)::INTEGER + (library / grounded < 0.3)::INTEGER + (metrics_promoted < 3)::INTEGER + (verified < 2)::INTEGER + (aliases = 0)::INTEGER FROM s""")
def gates(spark, sf_dir):
    o = _observations(spark, sf_dir)
    a = scope.abduction_gate(o, _explains(spark, sf_dir), scope.surplus(o, _explains(spark, sf_dir)).limit(0))
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("subject")).agg(F.count("*").alias("grounded"), F.count_if(k % 3 == 0).alias("library"), F.count_if(b > 5000).alias("metrics_promoted"), F.count_if(b < 0).alias("aliases"), F.count_if(b > 0).alias("verified"), F.lit(1).alias("candidates"))
    one = a.select(F.lit("abduction").alias("gate"), F.lit(-1).alias("subject"), "pass", F.size("failures").alias("failures"))
    return one.union(terms.gate(s).select(F.lit("domain"), "subject", "pass", F.size("failures")))
