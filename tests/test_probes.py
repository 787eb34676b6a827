import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import probes, spectral, sysid


def test_signals(spark):
    b = probes.prbs(spark, 254).orderBy("t").toPandas()["u"].to_numpy()
    assert set(b) == {-1.0, 1.0} and (b[:127] == b[127:]).all() and abs(b[:127].sum()) == 1
    t = spark.range(100).select((F.col("id") / 100).alias("t"))
    c = probes.chirp(t, 1.0, 5.0, 1.0).where("t = 0.5").first().u
    assert c == pytest.approx(math.sin(2 * math.pi * (0.5 + 2 * 0.25)))
    assert probes.multisine(t, [1.0, 2.0]).agg(F.max(F.abs("u"))).first()[0] <= 2
    cases = {r.kind: r.value for r in probes.boundary_cases(spark.createDataFrame([("a", 0.0, 10.0)], "param string, low double, high double")).collect()}
    assert cases["below"] < 0 < cases["low_inside"] < cases["middle"] == 5 and cases["above"] > 10


def test_step_response(spark):
    x = [1 - math.exp(-i / 10) * math.cos(i / 5) for i in range(200)]
    r = probes.step_response(spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "series_id string, t long, value double")).first()
    assert r.final == pytest.approx(1, abs=1e-3) and r.overshoot == pytest.approx(100 * (max(x) / x[-1] - 1)) and 0 < r.rise_time < r.settled_at < 100


def test_experiments(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(1, 1, 50), rng.normal(0, 2, 70)
    rows = spark.createDataFrame([("k", True, float(x)) for x in a] + [("k", False, float(x)) for x in b], "key string, arm boolean, value double")
    r = probes.two_sample(rows, "key").withColumn("p", probes.t_p_value("t", "df")).first()
    se = math.sqrt(a.var(ddof=1) / 50 + b.var(ddof=1) / 70)
    assert r.t == pytest.approx((a.mean() - b.mean()) / se) and 50 < r.df < 120 and 0 < r.p < 0.05
    e = {x.factor: x.effect for x in probes.main_effects(spark.createDataFrame([(p, q, 3.0 * p - q) for p in (True, False) for q in (True, False)], "p boolean, q boolean, value double"), ["p", "q"]).collect()}
    assert e == {"p": 3.0, "q": -1.0}
    s = probes.propagate(spark.createDataFrame([("a", 2.0, 1.0, 3.0), ("a", 1.0, 5.0, 8.0)], "key string, weight double, mean double, std double")).first()
    assert s["mean"] == 7 and s["std"] == 10


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 1)], "src long, dst long")
    got = {(r.src, r.dst): r.hops for r in probes.closure(e).collect()}
    assert got[1, 4] == 3 and got[1, 1] == 3 and len(got) == 12
    assert probes.closure(e.limit(0)).collect() == []


def test_models_from_data(spark):
    x = np.zeros((60, 2))
    x[0] = 1, 0.5
    for i in range(59):
        x[i + 1] = [[0.9, 0.2], [-0.2, 0.9]] @ x[i]
    states = spark.createDataFrame([("a", i, float(p), float(q)) for i, (p, q) in enumerate(x)], "series_id string, t long, p double, q double")
    modes = probes.dynamic_modes(states, ["p", "q"]).collect()
    assert sorted(round(m.im, 6) for m in modes) == [-0.2, 0.2] and all(m.re == pytest.approx(0.9) for m in modes)
    t = np.arange(0, 5, 0.01)
    logistic = 1 / (1 + 9 * np.exp(-t))
    terms = {r.term: r.value for r in probes.sparse_dynamics(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(logistic)], "series_id string, t long, x double"), ["x"], 0.01).collect()}
    assert terms == {"x": pytest.approx(1, abs=0.01), "x*x": pytest.approx(-1, abs=0.01)}
    j = {(r.output, r.param): r.slope for r in probes.jacobian(spark, {"f": "a*b", "g": "a + 3*b"}, {"a": 2.0, "b": 5.0}).collect()}
    assert j == {k: pytest.approx(v, abs=1e-6) for k, v in {("f", "a"): 5, ("f", "b"): 2, ("g", "a"): 1, ("g", "b"): 3}.items()}


def test_resonance_of_a_filter(spark):
    rng = np.random.default_rng(2)
    u, y = rng.normal(size=4096), np.zeros(4096)
    for i in range(2, 4096):
        y[i] = 1.8 * math.cos(2 * math.pi * 0.1) * y[i - 1] - 0.81 * y[i - 2] + u[i]
    io = spark.createDataFrame([("a", i, float(p), float(q)) for i, (p, q) in enumerate(zip(y, u, strict=True))], "series_id string, t long, y double, u double")
    found = spectral.resonances(spectral.transfer_function(io)).collect()
    assert any(abs(r.freq - 0.1) < 0.02 for r in found)


def test_families_are_ranked_together(spark):
    rng = np.random.default_rng(5)
    u, y = rng.uniform(-1, 1, 400), np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.5 * y[t - 1] + 0.8 * u[t - 1] ** 2 + rng.normal(0, 0.01)
    io = spark.createDataFrame([("a", i, float(p), float(q)) for i, (p, q) in enumerate(zip(y, u, strict=True))], "series_id string, t long, y double, u double")
    got = sysid.compare_families(io, [1], [1]).orderBy("rank").collect()
    assert [r.family for r in got] == ["NARMAX", "ARX"] and got[0].rss < got[1].rss
    made = sysid.simulate_polynomial(u, ["y1", "u0_u0"], np.array([0.5, 0.8]), 1, 1, 1, y, np.zeros(400))
    assert np.abs(made - y).max() < 0.1
