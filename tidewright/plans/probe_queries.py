"""Queries over probes and experiments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import probes, stationarity, stats, sysid
from ..sources.tables import V_MONTH, table, v_month
from .ledger_queries import _io
from .review_queries import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("step_response", f"""WITH {V_MONTH}, c AS (SELECT series_id, t, sum(value) OVER (PARTITION BY series_id ORDER BY t) / (t + 5) AS value FROM v_month), f AS (SELECT *, arg_max(value, t) OVER (PARTITION BY series_id) AS final FROM c)
SELECT series_id, round(max(final), 6) AS final, min(t) FILTER (value / final >= 0.9) - min(t) FILTER (value / final >= 0.1) AS rise_time, round(greatest(0, 100 * (max(value / final) - 1)), 6) AS overshoot,
  coalesce(max(t) FILTER (abs(value - final) > 0.02 * abs(final)), -1) + 1 AS settled_at, round(10 - max(final), 6) AS error FROM f GROUP BY 1""")
def step_response(spark, sf_dir):
    m = v_month(spark, sf_dir).withColumn("value", F.sum("value").over(stats.by_time().rowsBetween(Window.unboundedPreceding, 0)) / (F.col("t") + 5))
    return rounded(probes.step_response(m, 10.0))


@query("two_sample_test", """WITH g AS (SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS n1, count(*) FILTER (l_discount <= 0.05) AS n0, avg(l_quantity) FILTER (l_discount > 0.05) AS m1, avg(l_quantity) FILTER (l_discount <= 0.05) AS m0,
  var_samp(l_quantity) FILTER (l_discount > 0.05) AS v1, var_samp(l_quantity) FILTER (l_discount <= 0.05) AS v0 FROM lineitem GROUP BY 1)
SELECT l_returnflag, n1, n0, round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM g""")
def two_sample_test(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") > 0.05).alias("arm"), F.col("l_quantity").alias("value"))
    return rounded(rounded(probes.two_sample(rows, "l_returnflag"), 6, "difference", "t"), 4, "df")


@query("main_effects", """WITH r AS (SELECT l_quantity AS v, l_discount > 0.05 AS d, l_tax > 0.04 AS x, l_linenumber > 2 AS n FROM lineitem)
SELECT 'd' AS factor, round(avg(v) FILTER (d) - avg(v) FILTER (NOT d), 6) AS effect FROM r UNION ALL SELECT 'x', round(avg(v) FILTER (x) - avg(v) FILTER (NOT x), 6) FROM r UNION ALL SELECT 'n', round(avg(v) FILTER (n) - avg(v) FILTER (NOT n), 6) FROM r""")
def main_effects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("value"), (F.col("l_discount") > 0.05).alias("d"), (F.col("l_tax") > 0.04).alias("x"), (F.col("l_linenumber") > 2).alias("n"))
    return rounded(probes.main_effects(rows, ["d", "x", "n"]))


@query("dependency_closure", """WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey + 1 + n_regionkey AS dst FROM nation WHERE n_nationkey + 1 + n_regionkey < 25),
r(src, dst, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON r.dst = e.src WHERE r.hops < 30) SELECT src, dst, min(hops) AS hops FROM r GROUP BY 1, 2""")
def dependency_closure(spark, sf_dir):
    k, step = F.col("n_nationkey"), F.col("n_nationkey") + 1 + F.col("n_regionkey")
    return probes.closure(table(spark, sf_dir, "nation").select(k.alias("src"), step.alias("dst")).where("dst < 25"))


@query("boundary_cases", """WITH r AS (SELECT l_returnflag AS param, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1), s AS (SELECT *, greatest((high - low) / 1000, 1e-9) AS step FROM r)
SELECT param, kind, round(value, 6) AS value FROM (SELECT param, unnest(['low', 'high', 'below', 'above', 'low_inside', 'high_inside', 'middle', 'zero']) AS kind, unnest([low, high, low - step, high + step, low + step, high - step, (low + high) / 2, 0.0]) AS value FROM s)""")
def boundary_cases(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("param")).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return rounded(probes.boundary_cases(r))


@query("uncertainty_propagation", """SELECT l_orderkey AS key, round(sum(l_extendedprice * (1 - l_discount)), 6) AS mean, round(sqrt(sum(power((1 - l_discount) * l_quantity, 2))), 6) AS std FROM lineitem GROUP BY 1""")
def uncertainty_propagation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (1 - F.col("l_discount")).alias("weight"), F.col("l_extendedprice").alias("mean"), F.col("l_quantity").alias("std"))
    return rounded(probes.propagate(rows))


@query("probe_signals")
def probe_signals(spark, sf_dir):
    p = probes.prbs(spark, 254)
    out = probes.chirp(p.withColumnRenamed("u", "prbs"), 0.01, 0.2, 254.0).withColumnRenamed("u", "chirp")
    return rounded(probes.multisine(out, [0.02, 0.05, 0.11]).withColumnRenamed("u", "multisine"))


@query("dynamic_modes")
def dynamic_modes(spark, sf_dir):
    return rounded(probes.dynamic_modes(_io(spark, sf_dir), ["y", "u"]))


@query("sparse_dynamics")
def sparse_dynamics(spark, sf_dir):
    return rounded(probes.sparse_dynamics(_io(spark, sf_dir), ["y", "u"], 1.0, 0.01))


@query("structure_comparison")
def structure_comparison(spark, sf_dir):
    return rounded(sysid.compare_families(_io(spark, sf_dir), [1], [1]))


@query("unit_root_tests")
def unit_root_tests(spark, sf_dir):
    return rounded(stationarity.unit_root_tests(v_month(spark, sf_dir)))


@query("stationarity_findings")
def stationarity_findings(spark, sf_dir):
    return rounded(stationarity.stationarity_findings(v_month(spark, sf_dir)))
