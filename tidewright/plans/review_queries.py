"""Queries over whole series: statistics, order, errors, review. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, metrics, order, review, stats
from ..sources.series import clean
from ..sources.tables import V_DAY, V_EVENT, V_HOUR, V_MONTH, table, v_day, v_event, v_hour, v_month

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles rounded for comparison; infinities stay."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.when(F.abs(c) == float("inf"), F.col(c)).otherwise(F.round(c, digits)) for c in names})


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every 40th value missing and every 97th not finite."""
    v = F.when(F.col("t") % 40 == 7, None).when(F.col("t") % 97 == 11, float("inf")).otherwise(F.col("value"))
    return v_event(spark, sf_dir).withColumn("value", v)


RAW = f"""{V_EVENT}, v_raw AS (
  SELECT series_id, t, CASE WHEN t % 40 = 7 THEN NULL WHEN t % 97 = 11 THEN 'inf'::DOUBLE ELSE value END AS value FROM v_event)"""
CLEAN = f"""{RAW}, v_clean AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t, value FROM v_raw WHERE value IS NOT NULL AND isfinite(value))"""


@query("series_clean", f"WITH {CLEAN} SELECT series_id, t, value FROM v_clean")
def series_clean(spark, sf_dir):
    return clean(_raw(spark, sf_dir))


@query("series_zero_filled", f"WITH {RAW} SELECT series_id, t, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0.0::DOUBLE ELSE value END AS value FROM v_raw")
def series_zero_filled(spark, sf_dir):
    return clean(_raw(spark, sf_dir), "zero")


@query("series_profile", f"""WITH {V_EVENT}, e AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM v_event WINDOW w AS (PARTITION BY series_id))
SELECT series_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, count(DISTINCT value) AS n_unique,
  round(avg(CASE WHEN value = lo THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_min, round(avg(CASE WHEN value = hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_max FROM e GROUP BY 1""")
def series_profile(spark, sf_dir):
    return rounded(stats.profile(v_event(spark, sf_dir)), 6, "mean", "std", "median", "q1", "q3", "share_min", "share_max")


@query("iqr_outliers", f"""WITH {V_EVENT}, q AS (SELECT series_id, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v_event GROUP BY 1)
SELECT q.series_id, max(n) AS n, round(max(q1 - 1.5 * (q3 - q1)), 6) AS lo, round(max(q3 + 1.5 * (q3 - q1)), 6) AS hi,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_out, count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS n_extreme
FROM v_event JOIN q USING (series_id) GROUP BY 1""")
def iqr_outliers(spark, sf_dir):
    return rounded(stats.iqr_outliers(v_event(spark, sf_dir)))


_PAIR = """d AS (SELECT a.t, a.value AS x, b.value AS y FROM v_day a JOIN v_day b ON a.t = b.t WHERE a.series_id = 'ship' AND b.series_id = 'order')"""


@query("pearson_correlation", f"""WITH {V_DAY}, {_PAIR} SELECT 'ship-order' AS series_id, count(*) AS n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS r FROM d""")
def pearson_correlation(spark, sf_dir):
    day = v_day(spark, sf_dir)
    side = lambda s: day.where(F.col("series_id") == s).withColumn("series_id", F.lit("ship-order"))
    return rounded(stats.correlation(side("ship"), side("order")))


@query("shape_moments", f"""WITH {V_EVENT}, m AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM v_event GROUP BY 1)
SELECT series_id, round(avg(power((value - m) / s, 4)), 6) AS kurtosis, round(avg(power((value - m) / s, 3)), 6) AS skewness, round(max(abs(value)) / sqrt(avg(value * value)), 6) AS crest FROM v_event JOIN m USING (series_id) GROUP BY 1""")
def shape_moments(spark, sf_dir):
    rows = v_event(spark, sf_dir).groupBy("series_id")
    return rounded(rows.agg(stats.kurtosis().alias("kurtosis"), stats.skewness().alias("skewness"), (F.max(F.abs("value")) / F.sqrt(F.avg(F.col("value") ** 2))).alias("crest")))


def _baselines(view: str, period: int) -> str:
    return f"""b AS (SELECT series_id, count(*) OVER s AS n, t, abs(value - lag(value) OVER w) AS naive,
  CASE WHEN {period} > 1 AND count(*) OVER s > 2 * {period} THEN abs(value - lag(value, {period}) OVER w) END AS seasonal,
  CASE WHEN t >= 2 THEN abs(value - (lag(value) OVER w + (lag(value) OVER w - first_value(value) OVER w) / (t - 1))) END AS drift,
  CASE WHEN t >= greatest(10, (count(*) OVER s) // 5) THEN abs(value - avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS mean
  FROM {view} WINDOW s AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY t)),
b2 AS (SELECT series_id, max(n) AS n, avg(naive) AS naive_mae, avg(seasonal) AS seasonal_mae, avg(drift) AS drift_mae, avg(mean) AS mean_mae FROM b GROUP BY 1),
b3 AS (SELECT *, least(naive_mae, coalesce(seasonal_mae, 'inf'), coalesce(drift_mae, 'inf'), coalesce(mean_mae, 'inf')) AS best_mae FROM b2)"""


@query("baseline_errors", f"""WITH {V_MONTH}, {_baselines('v_month', 12)}
SELECT series_id, n, round(naive_mae, 6) AS naive_mae, round(seasonal_mae, 6) AS seasonal_mae, round(drift_mae, 6) AS drift_mae, round(mean_mae, 6) AS mean_mae, round(best_mae, 6) AS best_mae,
  CASE best_mae WHEN naive_mae THEN 'naive' WHEN seasonal_mae THEN 'seasonal_naive' WHEN drift_mae THEN 'drift' ELSE 'mean' END AS best FROM b3""")
def baseline_errors(spark, sf_dir):
    return rounded(metrics.baseline_errors(v_month(spark, sf_dir), 12))


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, model, t, actual, predicted: three simple forecasts of the months as models, from t = 12 on."""
    w = stats.by_time()
    last, first = F.lag("value").over(w), F.first("value").over(w)
    kinds = {"naive": last, "seasonal": F.lag("value", 12).over(w), "drift": last + (last - first) / F.nullif((F.col("t") - 1).cast("double"), F.lit(0.0))}
    rows = v_month(spark, sf_dir).select("series_id", "t", F.col("value").alias("actual"), *[c.alias(k) for k, c in kinds.items()]).where("t >= 12")
    return rows.select("series_id", "t", "actual", F.inline(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("predicted")) for k in kinds])))


V_PRED = f"""{V_MONTH}, v_pred0 AS (SELECT series_id, t, value AS actual, lag(value) OVER w AS naive, lag(value, 12) OVER w AS seasonal,
  lag(value) OVER w + (lag(value) OVER w - first_value(value) OVER w) / nullif(t - 1, 0)::DOUBLE AS drift FROM v_month WINDOW w AS (PARTITION BY series_id ORDER BY t)),
v_pred AS (SELECT series_id, t, actual, 'naive' AS model, naive AS predicted FROM v_pred0 WHERE t >= 12 UNION ALL SELECT series_id, t, actual, 'seasonal', seasonal FROM v_pred0 WHERE t >= 12
  UNION ALL SELECT series_id, t, actual, 'drift', drift FROM v_pred0 WHERE t >= 12)"""
_SCALE = """sc AS (SELECT series_id, avg(abs(e)) AS abs_scale, sqrt(avg(e * e)) AS rms_scale FROM (SELECT series_id, value - lag(value, 12) OVER (PARTITION BY series_id ORDER BY t) AS e FROM v_month) GROUP BY 1)"""


@query("compare_models", f"""WITH {V_PRED}, {_SCALE}, m AS (SELECT series_id, model, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg(power(actual - predicted, 2))) AS rmse,
  1 - sum(power(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2, 100 * sum(abs(actual - predicted)) / sum(abs(actual)) AS wape, avg(predicted - actual) AS bias FROM v_pred GROUP BY 1, 2)
SELECT series_id, model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(wape, 6) AS wape, round(bias, 6) AS bias, round(mae / abs_scale, 6) AS mase, round(rmse / rms_scale, 6) AS rmsse,
  row_number() OVER (PARTITION BY series_id ORDER BY mae / abs_scale, model) AS rank FROM m JOIN sc USING (series_id)""")
def compare_models(spark, sf_dir):
    return rounded(metrics.compare_models(v_pred(spark, sf_dir), metrics.naive_scale(v_month(spark, sf_dir), 12)))


@query("mase_rmsse_wape", f"""WITH {V_PRED}, {_SCALE} SELECT series_id, round(avg(abs(actual - predicted)) / max(abs_scale), 6) AS mase, round(sqrt(avg(power(actual - predicted, 2))) / max(rms_scale), 6) AS rmsse,
  round(100 * sum(abs(actual - predicted)) / sum(abs(actual)), 6) AS wape FROM v_pred JOIN sc USING (series_id) WHERE model = 'naive' GROUP BY 1""")
def mase_rmsse_wape(spark, sf_dir):
    rows = v_pred(spark, sf_dir).where("model = 'naive'").join(metrics.naive_scale(v_month(spark, sf_dir), 12), "series_id")
    return rounded(rows.groupBy("series_id").agg(metrics.scaled(metrics.mae(), F.max("abs_scale")).alias("mase"), metrics.scaled(metrics.rmse(), F.max("rms_scale")).alias("rmsse"), metrics.wape().alias("wape")))


@query("pinball_loss", f"""WITH {V_PRED}, q AS (SELECT unnest([0.05::DOUBLE, 0.5, 0.95]) AS tau) SELECT series_id, model, tau,
  round(avg(CASE WHEN actual >= predicted THEN tau * (actual - predicted) ELSE (tau - 1) * (actual - predicted) END), 6) AS loss FROM v_pred, q GROUP BY 1, 2, 3""")
def pinball_loss(spark, sf_dir):
    rows = v_pred(spark, sf_dir).groupBy("series_id", "model").agg(*[metrics.pinball(q).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95))])
    return rounded(rows.select("series_id", "model", F.inline(F.array(*[F.struct(F.lit(q).alias("tau"), F.col(f"q{i}").alias("loss")) for i, q in enumerate((0.05, 0.5, 0.95))]))))


@query("forecast_value_added", f"""WITH {V_PRED}, m AS (SELECT series_id, model, avg(abs(actual - predicted)) AS mae FROM v_pred GROUP BY 1, 2)
SELECT m.series_id, m.model, round(100 * (n.mae - m.mae) / n.mae, 6) AS fva FROM m JOIN m n ON m.series_id = n.series_id AND n.model = 'naive'""")
def forecast_value_added(spark, sf_dir):
    m = v_pred(spark, sf_dir).groupBy("series_id", "model").agg(metrics.mae().alias("mae"))
    naive = m.where("model = 'naive'").select("series_id", F.col("mae").alias("naive"))
    return rounded(m.join(naive, "series_id").select("series_id", "model", metrics.fva(F.col("mae"), F.col("naive")).alias("fva")))


@query("info_criteria", """WITH g AS (SELECT l_returnflag AS series_id, l_linenumber AS k, count(*) AS n, round(sum(l_discount), 2) AS rss FROM lineitem GROUP BY 1, 2)
SELECT series_id, k, n, round(n * ln(rss / n) + 2 * k, 6) AS aic, round(n * ln(rss / n) + k * ln(n), 6) AS bic,
  CASE WHEN n - k - 1 <= 0 THEN 'inf'::DOUBLE ELSE round(n * ln(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)::DOUBLE, 6) END AS aicc, round(rss / n * (n + k) / (n - k), 6) AS fpe FROM g""")
def info_criteria(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 2).alias("rss"))
    return rounded(g.select("series_id", "k", "n", *[c.alias(k) for k, c in metrics.info_criteria(F.col("n"), F.col("k"), F.col("rss")).items()]))


# --- order ------------------------------------------------------------------------------------


@query("first_difference", f"WITH {V_MONTH}, d AS (SELECT series_id, t, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS value FROM v_month) SELECT series_id, t, round(value, 9) AS value FROM d WHERE value IS NOT NULL")
def first_difference(spark, sf_dir):
    return rounded(order.diff(v_month(spark, sf_dir)), 9)


@query("diff_snr", f"WITH {V_EVENT}, d AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS e FROM v_event) SELECT series_id, count(e) AS n, round(abs(avg(e)) / stddev_samp(e), 6) AS snr FROM d GROUP BY 1")
def diff_snr(spark, sf_dir):
    return rounded(order.diff_snr(v_event(spark, sf_dir)))


def _acf(view: str, lags: int = 40) -> str:
    return f"""ac0 AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS n FROM {view}),
ac1 AS (SELECT series_id, max(n) AS n, sum(x * x) AS v FROM ac0 GROUP BY 1),
ac AS (SELECT a.series_id, max(c.n) AS n, a.lag, coalesce(sum(a.x * b.x) / nullif(max(c.v), 0), 0) AS acf
  FROM (SELECT ac0.*, unnest(range(1, {lags + 1})) AS lag FROM ac0) a JOIN ac0 b ON a.series_id = b.series_id AND b.t = a.t - a.lag JOIN ac1 c ON c.series_id = a.series_id
  WHERE a.lag <= a.n // 2 GROUP BY a.series_id, a.lag UNION ALL SELECT series_id, n, 0, 1.0 FROM ac1)"""


@query("acf", f"WITH {V_MONTH}, {_acf('v_month')} SELECT series_id, n, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM ac")
def acf(spark, sf_dir):
    return rounded(order.acf(v_month(spark, sf_dir)))


@query("acf_by_join", f"WITH {V_HOUR}, {_acf('v_hour', 24)} SELECT series_id, n, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM ac WHERE lag > 0")
def acf_by_join(spark, sf_dir):
    return rounded(order.acf_join(v_hour(spark, sf_dir), 24))


@query("ljung_box_q", f"WITH {V_MONTH}, {_acf('v_month')} SELECT series_id, n, 20 AS lags, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 6) AS q FROM ac WHERE lag BETWEEN 1 AND 20 GROUP BY 1, 2")
def ljung_box_q(spark, sf_dir):
    return rounded(order.ljung_box(order.acf(v_month(spark, sf_dir))))


_STUCK = """st AS (SELECT series_id, sum(length)::BIGINT AS n, max(length) AS max_run FROM (SELECT series_id, run, count(*) AS length FROM (
  SELECT series_id, sum(new) OVER (PARTITION BY series_id ORDER BY t) AS run FROM (SELECT series_id, t, CASE WHEN value = lag(value) OVER (PARTITION BY series_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM {v})) GROUP BY 1, 2) GROUP BY 1)"""


@query("stuck_runs", f"WITH {V_HOUR}, {_STUCK.format(v='v_hour')} SELECT series_id, n, max_run FROM st")
def stuck_runs(spark, sf_dir):
    return order.stuck_runs(v_hour(spark, sf_dir))


_DIRECTION = """di AS (SELECT series_id, count(e) AS n, count(*) FILTER (e > 0) AS up, count(*) FILTER (e < 0) AS down, count(*) FILTER (e = 0) AS flat
  FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS e FROM {v}) GROUP BY 1),
de AS (SELECT *, -list_sum(list_transform(list_filter([up, down, flat], lambda c: c > 0), lambda c: c / n * log2(c / n))) / log2(3) AS entropy FROM di)"""


@query("direction_entropy", f"WITH {V_HOUR}, {_DIRECTION.format(v='v_hour')} SELECT series_id, n, up, down, flat, round(entropy, 6) AS entropy FROM de")
def direction_entropy(spark, sf_dir):
    return rounded(order.direction_entropy(v_hour(spark, sf_dir)))


def _entropy(view: str) -> str:
    return f"""pe0 AS (SELECT series_id, t, count(*) OVER (PARTITION BY series_id) AS n, [lead(value, 0) OVER w, lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w, lead(value, 4) OVER w] AS p FROM {view} WINDOW w AS (PARTITION BY series_id ORDER BY t)),
pe1 AS (SELECT series_id, t, n, CASE WHEN n < 200 THEN 3 WHEN n < 1000 THEN 4 ELSE 5 END AS o, p FROM pe0),
pe2 AS (SELECT series_id, o, array_to_string(list_transform(list_sort(list_transform(range(1, o + 1), lambda i: struct_pack(v := p[i], i := i))), lambda x: x.i), ',') AS pattern FROM pe1 WHERE t <= n - o),
pe3 AS (SELECT series_id, o, pattern, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS p FROM pe2 GROUP BY 1, 2, 3),
pe AS (SELECT series_id, o, -sum(p * ln(p)) / ln(factorial(o)) AS pe FROM pe3 GROUP BY 1, 2)"""


@query("permutation_entropy", f"WITH {V_HOUR}, {_entropy('v_hour')} SELECT series_id, CAST(o AS INTEGER) AS \"order\", round(pe, 6) AS pe FROM pe")
def permutation_entropy(spark, sf_dir):
    h = v_hour(spark, sf_dir)
    n = F.count("value").over(stats.whole())
    return rounded(order.permutation_entropy(h.withColumn("o", review.entropy_order(n)), F.col("o")))


_SEASON = """se0 AS (SELECT series_id, n, lag, acf, lag(acf) OVER w AS before, lead(acf) OVER w AS after FROM ac WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
se AS (SELECT series_id, arg_min(lag, (-acf, lag)) AS period FROM se0 WHERE lag >= 2 AND acf > before AND acf > after AND acf > 2 / sqrt(n) AND acf > 0.1 GROUP BY 1)"""


@query("infer_seasonality", f"WITH {V_MONTH}, v_wave AS (SELECT series_id, t, value + avg(value) OVER (PARTITION BY series_id) * sin(2 * pi() * t / 12) AS value FROM v_month), {_acf('v_wave')}, {_SEASON} SELECT series_id, CAST(period AS INTEGER) AS period FROM se")
def infer_seasonality(spark, sf_dir):
    wave = F.avg("value").over(stats.whole()) * F.sin(2 * F.pi() * F.col("t") / 12)
    return order.infer_seasonality(order.acf(v_month(spark, sf_dir).withColumn("value", F.col("value") + wave)))


_HALVES = """hs AS (SELECT series_id, max(n) AS n, abs(avg(value) FILTER (NOT f) - avg(value) FILTER (f)) / greatest(stddev_samp(value), 1e-12) AS mean_shift,
  greatest(stddev_samp(value) FILTER (f), 1e-12) / greatest(stddev_samp(value) FILTER (NOT f), 1e-12) AS std_ratio
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, t < (count(*) OVER (PARTITION BY series_id)) // 2 AS f FROM {v}) GROUP BY 1)"""


@query("half_split", f"WITH {V_EVENT}, {_HALVES.format(v='v_event')} SELECT series_id, n, round(mean_shift, 6) AS mean_shift, round(std_ratio, 6) AS std_ratio FROM hs")
def half_split(spark, sf_dir):
    return rounded(order.half_split(v_event(spark, sf_dir)))


def _trend(view: str, half: int) -> str:
    return f"""tr AS (SELECT series_id, count(*) AS n, greatest(0, 1 - var_pop(value - m) / var_pop(value)) AS trend_strength
  FROM (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS m FROM {view}) GROUP BY 1)"""


@query("trend_strength", f"WITH {V_MONTH}, {_trend('v_month', 6)} SELECT series_id, n, round(trend_strength, 6) AS trend_strength FROM tr")
def trend_strength(spark, sf_dir):
    return rounded(order.trend_strength(v_month(spark, sf_dir), 12))


_BREAK = """sb0 AS (SELECT series_id, t, value, n, w, w // 2 AS step FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, greatest(20, (count(*) OVER (PARTITION BY series_id)) // 5) AS w FROM {v})),
sb1 AS (SELECT series_id, n, unnest(range(0, n - w + 1, step)) AS s, w FROM (SELECT DISTINCT series_id, n, w, step FROM sb0)),
sb2 AS (SELECT a.series_id, a.n, a.s, var_pop(value) AS v FROM sb1 a JOIN sb0 b ON a.series_id = b.series_id AND b.t >= a.s AND b.t < a.s + a.w GROUP BY 1, 2, 3),
sb AS (SELECT series_id, n, count(*) AS segments, CASE WHEN min(v) > 0 THEN max(v) / min(v) ELSE 'inf'::DOUBLE END AS ratio FROM sb2 GROUP BY 1, 2)"""


@query("structural_break", f"WITH {V_MONTH}, {_BREAK.format(v='v_month')} SELECT series_id, n, segments, round(ratio, 6) AS ratio FROM sb")
def structural_break(spark, sf_dir):
    return rounded(order.structural_break(v_month(spark, sf_dir)))


_REGIMES = """rw AS (SELECT series_id, least(t // greatest(n // 5, 1), 4) AS win, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM {v}) GROUP BY 1, 2)"""


@query("regime_windows", f"WITH {V_MONTH}, {_REGIMES.format(v='v_month')} SELECT series_id, win, n, round(mean, 6) AS mean, round(std, 6) AS std FROM rw")
def regime_windows(spark, sf_dir):
    return rounded(order.regime_windows(v_month(spark, sf_dir)))


@query("ks_neighbours", f"""WITH {V_MONTH}, w AS (SELECT series_id, value, least(t // greatest(n // 5, 1), 4) AS w FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_month)),
p AS (SELECT series_id, w AS win, value, 1 AS a, 0 AS b FROM w WHERE w < 4 UNION ALL SELECT series_id, w - 1, value, 0, 1 FROM w WHERE w > 0),
g AS (SELECT series_id, win, abs(sum(a) OVER u / sum(a) OVER o - sum(b) OVER u / sum(b) OVER o) AS gap, sum(a) OVER o AS n, sum(b) OVER o AS m FROM p WINDOW o AS (PARTITION BY series_id, win), u AS (PARTITION BY series_id, win ORDER BY value))
SELECT series_id, win, round(max(gap), 6) AS d, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM g GROUP BY 1, 2""")
def ks_neighbours(spark, sf_dir):
    return rounded(order.ks_neighbours(v_month(spark, sf_dir)))


@query("settling_time", f"""WITH {V_MONTH}, c AS (SELECT series_id, t, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM v_month),
f AS (SELECT *, last_value(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM c)
SELECT series_id, round(max(final), 6) AS final, coalesce(max(t) FILTER (abs(value - final) > abs(final) * 0.02), -1) + 1 AS settled_at FROM f GROUP BY 1""")
def settling_time(spark, sf_dir):
    from pyspark.sql import Window

    running = F.avg("value").over(stats.by_time().rowsBetween(Window.unboundedPreceding, 0))
    return rounded(order.settling(v_month(spark, sf_dir).withColumn("value", running)))


# --- review -----------------------------------------------------------------------------------


def _rung(cases: list[tuple[str, str, str]], otherwise: tuple[str, str] = ("PASS", "INFO")) -> tuple[str, str]:
    if not cases:
        return f"'{otherwise[0]}'", f"'{otherwise[1]}'"
    pick = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) + f" ELSE '{otherwise[k - 1]}' END"
    return pick(1), pick(2)


def _finding(view: str, no: int, phase: str, name: str, cases: list, value: str = "NULL", given: str = "TRUE", otherwise: tuple[str, str] = ("PASS", "INFO")) -> str:
    verdict, severity = _rung(cases, otherwise)
    return f"SELECT series_id, {no} AS phase_no, '{phase}' AS phase, '{name}' AS \"check\", {verdict} AS verdict, {severity} AS severity, round(CAST({value} AS DOUBLE), 6) AS value FROM {view} WHERE {given}"


def _coherence(view: str, raw: str | None = None) -> tuple[str, str]:
    n_raw = f"(SELECT count(*) FROM {raw} r WHERE r.series_id = e.series_id)" if raw else "count(*)"
    cte = f"""p1 AS (SELECT series_id, count(*) AS n, {n_raw} AS n_raw, count(DISTINCT value) AS uniq, greatest(avg((value = lo)::INTEGER), avg((value = hi)::INTEGER)) AS clip, min(value) AS lo, max(value) AS hi
  FROM (SELECT *, min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi FROM {view}) e GROUP BY 1)"""
    lost = "100 * (n_raw - n) / n_raw"
    f = lambda *a, **k: _finding("p1", 1, "coherence", *a, **k)
    return cte, " UNION ALL ".join([
        f("min_length", [("n < 10", "REJECT", "CRITICAL"), ("n < 30", "WARN", "MEDIUM")], "n"),
        f("parse_failures", [(f"{lost} > 20", "FAIL", "HIGH"), (f"{lost} > 5", "WARN", "MEDIUM")], lost),
        f("constant_series", [], "NULL", "n > 1 AND uniq = 1", ("REJECT", "CRITICAL")),
        f("low_cardinality", [], "uniq", "n > 1 AND uniq > 1 AND uniq <= 3", ("WARN", "MEDIUM")),
        f("value_diversity", [], "uniq", "n > 1 AND uniq > 3"),
        f("value_clipping", [("clip > 0.1", "WARN", "MEDIUM")], "clip", "n > 10 AND hi > lo"),
    ])


def _quality(view: str, raw: str | None = None) -> tuple[str, str]:
    n_raw = f"(SELECT count(*) FROM {raw} r WHERE r.series_id = q.series_id)" if raw else "max(q.n)"
    cte = f"""{_STUCK.format(v=view)}, q0 AS (SELECT series_id, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {view} GROUP BY 1),
p2 AS (SELECT q.series_id, max(q.n) AS n, {n_raw} AS n_raw, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_out,
  count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS n_ext, max(max_run) AS run FROM {view} v JOIN q0 q USING (series_id) JOIN st USING (series_id) GROUP BY 1)"""
    lost = "100 * (n_raw - n) / n_raw"
    f = lambda *a, **k: _finding("p2", 2, "data_quality", *a, **k)
    return cte, " UNION ALL ".join([
        f("missing_values", [(f"{lost} > 20", "FAIL", "HIGH"), (f"{lost} > 5", "WARN", "MEDIUM")], lost),
        f("outliers_iqr", [("100 * n_out / n > 10", "WARN", "MEDIUM")], "100 * n_out / n", "n >= 20"),
        f("extreme_outliers", [("n_ext > 0", "WARN", "HIGH")], "n_ext", "n >= 20"),
        f("outliers_iqr", [], "NULL", "n < 20", ("SKIP", "INFO")),
        f("stuck_values", [("100 * run / n > 10", "WARN", "HIGH"), ("run > greatest(5, n * 0.02)", "WARN", "LOW")], "run", "n > 10"),
    ])


def _forecastability(view: str, infer: bool = True) -> tuple[str, str]:
    cte = f"""{_acf(view)}, {_SEASON}, {_DIRECTION.format(v=view)}, {_entropy(view)},
sn AS (SELECT series_id, abs(avg(e)) / stddev_samp(e) AS snr FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS e FROM {view}) GROUP BY 1),
p4 AS (SELECT ac.series_id, max(ac.n) AS n, count(*) FILTER (lag >= 1 AND abs(acf) > 2 / sqrt(ac.n)) AS n_sig, sum(acf * acf) FILTER (lag BETWEEN 1 AND 20) AS energy, max(acf) FILTER (lag = 1) AS lag1,
  max(entropy) AS entropy, max(pe) AS pe, max(snr) AS snr, max(period) AS period FROM ac LEFT JOIN de USING (series_id) LEFT JOIN pe USING (series_id) LEFT JOIN sn USING (series_id) LEFT JOIN se USING (series_id) GROUP BY 1)"""
    f = lambda *a, **k: _finding("p4", 4, "forecastability", *a, **k)
    return cte, " UNION ALL ".join([
        f("forecastability", [], "NULL", "n < 20", ("SKIP", "INFO")),
        f("acf_structure", [("n_sig = 0", "WARN", "HIGH")], "energy", "n >= 20"),
        f("lag1_persistence", [("abs(lag1) < 2 / sqrt(n)", "WARN", "MEDIUM")], "lag1", "n >= 20"),
        f("direction_entropy", [("entropy > 0.95", "WARN", "MEDIUM")], "entropy", "n >= 50"),
        f("permutation_entropy", [("pe > 0.95", "WARN", "HIGH"), ("pe > 0.85", "WARN", "MEDIUM")], "pe", "n >= 20 AND pe IS NOT NULL"),
        f("snr_diffs", [("snr < 0.05", "WARN", "MEDIUM")], "snr", "n >= 20"),
        f("inferred_seasonality", [], "period", f"{'TRUE' if infer else 'FALSE'} AND n >= 50 AND period IS NOT NULL"),
    ])


def _others(view: str, period: int) -> tuple[str, str]:
    half = (period if period >= 3 else 5) // 2
    cte = f"""{_HALVES.format(v=view)}, {_trend(view, half)}, {_BREAK.format(v=view)}, {_baselines(view, period)}, {_REGIMES.format(v=view)},
p10 AS (SELECT series_id, max(m.n) AS n, (max(mean) - min(mean)) / max(s) AS drift, CASE WHEN min(std) > 0 THEN max(std) / min(std) ELSE 'inf'::DOUBLE END AS vol
  FROM rw JOIN (SELECT series_id, count(*) AS n, stddev_samp(value) AS s FROM {view} GROUP BY 1) m USING (series_id) GROUP BY 1),
p5 AS (SELECT series_id, tr.n, trend_strength, segments, ratio FROM tr LEFT JOIN sb USING (series_id))"""
    return cte, " UNION ALL ".join([
        _finding("hs", 3, "stationarity", "stationarity", [], "NULL", "n < 20", ("SKIP", "INFO")),
        _finding("hs", 3, "stationarity", "mean_shift_heuristic", [("mean_shift > 1.5", "WARN", "MEDIUM")], "mean_shift", "n >= 20"),
        _finding("hs", 3, "stationarity", "variance_ratio_heuristic", [("std_ratio > 2 OR std_ratio < 0.5", "WARN", "MEDIUM")], "std_ratio", "n >= 20"),
        _finding("p5", 5, "decomposition", "decomposition", [], "NULL", "n < 30", ("SKIP", "INFO")),
        _finding("p5", 5, "decomposition", "trend_strength_heuristic", [], "trend_strength", "n >= 30"),
        _finding("p5", 5, "decomposition", "structural_break", [("ratio > 4", "WARN", "HIGH"), ("ratio > 2", "WARN", "LOW")], "ratio", "n >= 60 AND segments >= 3"),
        _finding("b3", 6, "baselines", "baselines", [], "NULL", "n < 10", ("SKIP", "INFO")),
        _finding("b3", 6, "baselines", "baseline_errors", [], "best_mae", "n >= 10"),
        _finding("p10", 10, "regimes", "regimes", [], "NULL", "n < 50", ("SKIP", "INFO")),
        _finding("p10", 10, "regimes", "regime_mean_drift", [("drift > 2", "WARN", "HIGH"), ("drift > 1", "WARN", "MEDIUM")], "drift", "n >= 50"),
        _finding("p10", 10, "regimes", "volatility_clustering", [("vol > 3", "WARN", "HIGH"), ("vol > 1.5", "WARN", "LOW")], "vol", "n >= 50"),
        _finding("p10", 10, "regimes", "regime_recommendation", [], "drift", "n >= 50 AND (drift > 1.5 OR vol > 2.5)", ("WARN", "MEDIUM")),
    ])


def _counted(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count("*").alias("n_raw"))


_C, _CF = _coherence("v_clean", "v_raw")


@query("phase_coherence", f"WITH {CLEAN}, {_C} {_CF}")
def phase_coherence(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return rounded(review.coherence(clean(raw), _counted(raw)))


_D, _DF = _quality("v_clean", "v_raw")


@query("phase_data_quality", f"WITH {CLEAN}, {_D} {_DF}")
def phase_data_quality(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return rounded(review.data_quality(clean(raw), _counted(raw)))


_E, _EF = _forecastability("v_month")


@query("phase_forecastability", f"WITH {V_MONTH}, {_E} {_EF}")
def phase_forecastability(spark, sf_dir):
    return rounded(review.forecastability(v_month(spark, sf_dir)))


def _whole_review(period: int) -> str:
    parts = [_coherence("v_month"), _quality("v_month"), _forecastability("v_month", False), _others("v_month", period)]
    return f"WITH {V_MONTH}, {', '.join(p[0] for p in parts)}, fi AS ({' UNION ALL '.join(p[1] for p in parts)})"


@query("review_findings", f"{_whole_review(12)} SELECT * FROM fi")
def review_findings(spark, sf_dir):
    return rounded(review.full_review(v_month(spark, sf_dir), 12))


@query("review_verdict", f"""{_whole_review(12)}, k AS (SELECT *, list_position(['SKIP', 'PASS', 'WARN', 'FAIL', 'REJECT'], verdict) AS rank FROM fi)
SELECT series_id, phase_no, ['SKIP', 'PASS', 'WARN', 'FAIL', 'REJECT'][max(rank)] AS verdict, count(*) AS n_findings, count(*) FILTER (rank >= 4) AS red_flags, count(*) FILTER (rank = 3) AS warnings FROM k GROUP BY 1, 2""")
def review_verdict(spark, sf_dir):
    return findings.rollup(review.full_review(v_month(spark, sf_dir), 12), "phase_no")


