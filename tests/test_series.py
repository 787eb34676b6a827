"""Sources, statistics, order operators and the review against closed forms and plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import scalars
from tidewright.operators import conformal, features, findings, metrics, order, review, splits, stats
from tidewright.sources import series as src


def frame(spark, **named):
    rows = [(k, i, float(v)) for k, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, t long, value double")


def one(df):
    return df.collect()[0].asDict()


@pytest.fixture(scope="module")
def demo():
    rng = random.Random(42)
    return {
        "trend": [0.5 * t + 10 * math.sin(2 * math.pi * t / 12) + rng.gauss(0, 0.1) for t in range(120)],
        "walk": list(np.cumsum([rng.gauss(0, 1) for _ in range(100)])),
        "constant": [5.0] * 50,
        "short": [1.0, 2.0, 3.0],
        "regime": [100 + 0.02 * t + 10 * math.sin(2 * math.pi * t / 52) + rng.gauss(0, 3 if t < 350 else 8) for t in range(500)],
    }


def test_csv_cells_and_policies(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nnan,3\n1d,4\n 5 ,inf\n,6\n1e3,7\n")
    (tmp_path / "b.csv").write_text("x,y\n9,1\n")
    got = {(r.series_id, r.t): r.value for r in src.series_from_csv(spark, str(tmp_path), "x").collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 5.0, ("a", 2): 1000.0, ("b", 0): 9.0}
    zero = [r.value for r in src.series_from_csv(spark, str(tmp_path / "a.csv"), "x", "zero").orderBy("t").collect()]
    assert zero == [1.0, 0.0, 0.0, 5.0, 0.0, 1000.0]
    pair = src.pair_from_csv(spark, str(tmp_path / "a.csv"), "x", "y").orderBy("t").collect()
    assert math.isnan(pair[1].y) and math.isnan(pair[3].u) and pair[5].y == 1000
    with pytest.raises(ValueError, match="no column z"):
        src.series_from_csv(spark, str(tmp_path / "a.csv"), "z")
    with pytest.raises(ValueError, match="policy"):
        src.clean(frame(spark, a=[1]), "guess")


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    src.write_documents(df, str(tmp_path / "d"))
    src.write_documents(df, str(tmp_path / "d"))
    assert sorted(src.read_documents(spark, str(tmp_path / "d"), df.schema).collect()) == sorted(df.collect())


def test_scalars(spark):
    row = one(spark.range(1).select(
        scalars.bayes_update(F.lit(0.5), F.lit(3.0)).alias("a"), scalars.bayes_update(F.lit(0.5), F.lit(0.0)).alias("b"), scalars.odds_update(F.lit(0.5), F.lit(-1.0)).alias("c"),
        scalars.next_pow2(F.lit(1)).alias("d"), scalars.next_pow2(F.lit(64)).alias("e"), scalars.next_pow2(F.lit(65)).alias("f"), scalars.parse_bool(F.lit(" Yes")).alias("g"),
        scalars.parse_plausibility(F.lit("1,,3,4")).alias("h"), scalars.parse_aliases(F.lit("a, ,b ")).alias("i"), scalars.jaccard(scalars.tokens(F.lit("A, b c")), scalars.tokens(F.lit("b C d"))).alias("j"),
        scalars.clamp_probability(F.lit(2.0)).alias("k"), scalars.pearson_p(F.lit(0.5), F.lit(30)).alias("p"),
    ))
    assert row["a"] == pytest.approx(0.75) and row["b"] == row["c"] == 0.001 and (row["d"], row["e"], row["f"]) == (1, 64, 128)
    assert row["g"] is True and row["h"] == [1.0, None, 3.0, 4.0] and row["i"] == ["a", "b"] and row["j"] == 0.5 and row["k"] == 0.999
    assert row["p"] == pytest.approx(0.004895, abs=1e-5)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(scalars.bayes_update(F.lit(0.5), F.col("id") - 1.0)).collect()
    names = spark.createDataFrame([("H2",), ("H10",), ("H1",)], "x string")
    assert [r.x for r in names.orderBy(*scalars.natural_key(F.col("x"))).collect()] == ["H1", "H2", "H10"]
    assert one(names.agg(scalars.next_counter(F.col("x"), "H").alias("n")))["n"] == 11


def test_special_functions():
    assert scalars.student_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert scalars.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert scalars.incomplete_beta(0.3, 2, 3) == pytest.approx(0.3483, abs=1e-9)
    assert scalars.chi2_sf_value(18.307, 10) == pytest.approx(0.05, abs=2e-3)
    assert scalars.correlation_p_value(1.0, 9) == 0 and scalars.correlation_p_value(0.4, 2) == 1


def test_profile_and_outliers(spark, demo):
    rows = {r.series_id: r for r in stats.profile(frame(spark, **demo)).collect()}
    for k, v in demo.items():
        assert rows[k].n == len(v) and rows[k]["std"] == pytest.approx(statistics.stdev(v)) and rows[k].q1 == pytest.approx(np.percentile(v, 25))
    out = one(stats.iqr_outliers(frame(spark, a=[*range(40), 1000])))
    assert out["n_out"] == out["n_extreme"] == 1
    assert one(frame(spark, a=[]).agg(stats.mean().alias("m"), stats.std().alias("s"), stats.percentile(50).alias("p"))) == {"m": 0, "s": 0, "p": 0}


def test_autocorrelation_both_ways(spark, demo):
    s = frame(spark, **{k: demo[k] for k in ("trend", "constant", "short")})
    a = {(r.series_id, r.lag): r.acf for r in order.acf(s).collect()}
    b = {(r.series_id, r.lag): r.acf for r in order.acf_join(s).collect()}
    x = np.array(demo["trend"]) - np.mean(demo["trend"])
    for k in range(1, 41):
        assert a["trend", k] == pytest.approx((x[k:] * x[:-k]).sum() / (x * x).sum()) and b["trend", k] == pytest.approx(a["trend", k])
    assert a["constant", 0] == 1 and a["constant", 5] == 0 and ("short", 1) in a and ("short", 2) not in a
    period = {r.series_id: r.period for r in order.infer_seasonality(order.acf(frame(spark, a=[math.sin(2 * math.pi * t / 12) for t in range(120)]))).collect()}
    assert period == {"a": 12}


def test_entropies_and_runs(spark, demo):
    s = frame(spark, up=range(60), walk=demo["walk"], flat=[1, 1, 1, 2, 2, 3])
    pe = {r.series_id: r.pe for r in order.permutation_entropy(s).collect()}
    assert pe["up"] == 0 and 0.8 < pe["walk"] <= 1
    ties = one(order.permutation_entropy(frame(spark, a=[1, 1, 1, 0, 0])))
    assert ties["pe"] == pytest.approx(-sum(p * math.log(p) for p in (1 / 3,) * 3) / math.log(6))
    assert {r.series_id: r.max_run for r in order.stuck_runs(s).collect()}["flat"] == 3
    d = {r.series_id: r.entropy for r in order.direction_entropy(s).collect()}
    assert d["up"] == 0 and 0 < d["walk"] < 1
    assert {r.series_id: r.snr for r in order.diff_snr(s).collect()}["up"] == math.inf


def test_order_does_not_depend_on_rows(spark, demo):
    s = frame(spark, **demo)
    for f in (order.stuck_runs, order.structural_break, order.regime_summary, order.trend_strength, stats.profile):
        said = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert said(f(s)) == said(f(s.orderBy(F.rand(1)).repartition(5)))
        assert said(f(s.where("series_id = 'trend'"))) == said(f(s).where("series_id = 'trend'"))


def test_segments_windows_settling(spark):
    x = [math.sin(t) for t in range(100)]
    r = one(order.structural_break(frame(spark, a=x)))
    parts = [np.var(x[s : s + 20]) for s in range(0, 81, 10)]
    assert r["segments"] == len(parts) and r["ratio"] == pytest.approx(max(parts) / min(parts))
    w = order.regime_windows(frame(spark, a=range(53))).orderBy("win").collect()
    assert [v.n for v in w] == [10, 10, 10, 10, 13]
    assert one(order.settling(frame(spark, a=[0, 2, 1.5, 1.01, 1.0, 1.0])))["settled_at"] == 3
    y = np.random.default_rng(1).normal(size=300)
    m = one(order.moving_average_snr(frame(spark, a=y)))
    smooth = np.convolve(y, np.ones(21) / 21, "same")
    assert m["w"] == 21 and m["snr"] == pytest.approx(smooth.var() / (y - smooth).var())
    ks = one(order.ks_neighbours(frame(spark, a=[0] * 10 + [1] * 10), 2))
    assert ks["d"] == 1 and ks["n"] == ks["m"] == 10


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 1.0)], "series_id string, actual double, predicted double")
    m = one(rows.groupBy("series_id").agg(metrics.mae().alias("mae"), metrics.rmse().alias("rmse"), metrics.r_squared().alias("r2"), metrics.wape().alias("wape"), metrics.bias().alias("bias"), metrics.pinball(0.9).alias("pin")))
    assert m["mae"] == 1 and m["rmse"] == pytest.approx(math.sqrt(5 / 3)) and m["r2"] == pytest.approx(1 - 5 / 2) and m["wape"] == 50 and m["bias"] == pytest.approx(-1 / 3) and m["pin"] == pytest.approx((0.1 + 0 + 1.8) / 3)
    none = one(rows.where("false").agg(metrics.mae().alias("mae"), metrics.r_squared().alias("r2")))
    assert math.isnan(none["mae"]) and math.isnan(none["r2"])
    c = one(spark.createDataFrame([(100, 3, 10.0)], "n int, k int, rss double").select(*[v.alias(k) for k, v in metrics.info_criteria(F.col("n"), F.col("k"), F.col("rss")).items()]))
    assert c["aic"] == pytest.approx(100 * math.log(0.1) + 6) and c["bic"] == pytest.approx(100 * math.log(0.1) + 3 * math.log(100)) and c["aicc"] == pytest.approx(c["aic"] + 24 / 96) and c["fpe"] == pytest.approx(0.1 * 103 / 97)


def test_review_of_demo_series(spark, demo):
    found = review.full_review(frame(spark, **demo))
    got = {}
    for r in found.collect():
        got.setdefault(r.series_id, {})[r.check] = r.verdict
    assert got["constant"]["constant_series"] == "REJECT" and "acf_structure" not in got["constant"]
    assert got["short"]["min_length"] == "REJECT" and len(got["short"]) <= 3
    assert got["trend"]["acf_structure"] == "PASS" and "inferred_seasonality" in got["trend"] and got["trend"]["mean_shift_heuristic"] == "WARN"
    assert got["regime"]["volatility_clustering"] in ("PASS", "WARN")
    verdicts = {r.series_id: r.verdict for r in findings.rollup(found).collect()}
    assert verdicts["constant"] == verdicts["short"] == "REJECT" and verdicts["trend"] == "WARN"
    assert set(review.quick_review(frame(spark, **demo)).select("phase_no").distinct().toPandas()["phase_no"]) == {1, 2, 3, 4, 5, 6}
    assert "constant_series" in one(findings.to_documents(found).where("series_id = 'constant'"))["report"]
    empty = frame(spark, a=[])
    assert review.full_review(empty).collect() == []


def test_phases_that_judge_models(spark):
    perfect = spark.createDataFrame([("a", k, float(i), float(i)) for k in ("train", "test") for i in range(10)], "series_id string, split string, actual double, predicted double")
    got = {r.check: r.verdict for r in review.overfitting(perfect).collect()}
    assert got["test_r2"] == "REJECT" and got["train_r2_memorization"] == "REJECT"
    biased = {r.check: r.verdict for r in review.residuals(frame(spark, a=[1 + 0.1 * (-1) ** i for i in range(50)])).collect()}
    assert biased["residual_bias"] == "FAIL" and biased["residual_acf"] == "FAIL"
    narrow = spark.createDataFrame([("a", float(i), i + 1.0, i + 2.0) for i in range(30)], "series_id string, actual double, lo double, hi double")
    assert {r.check: r.verdict for r in review.uncertainty(narrow).collect()}["coverage"] == "FAIL"
    bad = spark.createDataFrame([("a", i, float(i % 5), float(i % 5 + 9)) for i in range(30)], "series_id string, t long, actual double, predicted double")
    assert {r.check: r.verdict for r in review.baselines(frame(spark, a=[i % 5 for i in range(40)]), bad).collect()}["fva"] == "FAIL"


def test_features(spark):
    s = frame(spark, a=[10, 20, 30, 40, 50])
    rows = features.lag_features(s, (1,)).orderBy("t").collect()
    assert [r.lag_1 for r in rows] == [None, 10, 20, 30, 40]
    rolled = features.rolling_features(frame(spark, a=range(20)), (3,)).orderBy("t").collect()
    assert [r.rmean_3 for r in rolled[:5]] == [None, None, None, None, 2.0]
    io = spark.createDataFrame([("a", i, float(i), float(10 * i)) for i in range(6)], "series_id string, t long, y double, u double")
    r = features.arx_regressors(io, 2, 1, 1).orderBy("t").collect()
    assert [(x.t, x.y1, x.y2, x.u0) for x in r] == [(t, t - 1, t - 2, 10 * (t - 1)) for t in range(2, 6)]
    assert features.polynomial_basis(io, 1, 1, 2).columns[3:] == ["one", "y1", "u0", "y1_y1", "y1_u0", "u0_u0"]
    assert features.feature_matrix(frame(spark, a=range(60)), 12).count() == 60 - 29


def test_splits(spark):
    r = splits.walk_forward(frame(spark, a=range(50)), horizon=2).where("role = 'test'").orderBy("fold", "t").collect()
    assert [(x.fold, x.t) for x in r] == [(f, 30 + 4 * f + i) for f in range(5) for i in range(2)]
    assert splits.walk_forward(frame(spark, a=[1])).collect() == []
    short = splits.walk_forward(frame(spark, a=range(10))).groupBy("role").count().collect()
    assert {x.role: x["count"] for x in short} == {"train": 9, "test": 1}
    c = {x.role: x["count"] for x in splits.train_calib_test(frame(spark, a=range(100)), 10).groupBy("role").count().collect()}
    assert c == {"train": 72, "calib": 18, "test": 10}
    few = {x.role: x["count"] for x in splits.train_calib_test(frame(spark, a=range(9)), 3).groupBy("role").count().collect()}
    assert few == {"train": 9, "calib": 5, "test": 1}


def test_conformal(spark):
    res = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "series_id string, residual double")
    f = spark.createDataFrame([("a", 1, 100.0), ("b", 1, 5.0)], "series_id string, h int, yhat double")
    got = {r.series_id: (r.lo, r.hi, r.guarantee_ok) for r in conformal.intervals(res, f, 0.9).collect()}
    assert got == {"a": (81.0, 119.0, True), "b": (5.0, 5.0, False)}
    assert not conformal.intervals(res.limit(5), f, 0.9).where("series_id = 'a'").collect()[0].guarantee_ok
    cal = spark.createDataFrame([("a", 5.0, 0.0, 10.0)] * 5, "series_id string, actual double, lo double, hi double")
    test = spark.createDataFrame([("a", 0, 1.0, 4.0), ("z", 0, 1.0, 4.0)], "series_id string, t long, lo double, hi double")
    got = {r.series_id: (r.lo, r.hi) for r in conformal.cqr(cal, test).collect()}
    assert got == {"a": (2.5, 2.5), "z": (1.0, 4.0)}
