import numpy as np
import pytest

from tidewright.operators import stationarity


def test_statistics_on_known_series():
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    t, _, n = stationarity.dickey_fuller(noise)
    assert t < stationarity.critical(0.01, n)
    t, _, n = stationarity.dickey_fuller(walk)
    assert t > stationarity.critical(0.05, n)
    assert stationarity.kpss(noise)[1] > 0.05 and stationarity.kpss(walk)[1] <= 0.05
    assert stationarity.critical(0.05, 10**9) == pytest.approx(-2.86154)
    x = np.array([1.0, 2.0, 4.0, 7.0, 11.0, 12.0, 14.0, 13.0, 15.0, 18.0, 17.0, 20.0])
    d, a = np.diff(x), np.stack([x[:-1], np.ones(11)], axis=1)
    theta = np.linalg.solve(a.T @ a, a.T @ d)
    rest = d - a @ theta
    assert stationarity.dickey_fuller(x, 0)[0] == pytest.approx(theta[0] / np.sqrt(np.linalg.inv(a.T @ a)[0, 0] * (rest @ rest) / 9))


def test_share_of_false_alarms():
    rng = np.random.default_rng(4)
    hits = [stationarity.dickey_fuller(np.cumsum(rng.normal(size=200)), 0) for _ in range(300)]
    assert 0.01 < np.mean([t < stationarity.critical(0.05, n) for t, _, n in hits]) < 0.10


def test_findings(spark):
    rng = np.random.default_rng(3)
    own = {"noise": rng.normal(size=300), "walk": np.cumsum(rng.normal(size=300)), "flat": np.ones(50), "short": np.arange(5.0)}
    s = spark.createDataFrame([(k, i, float(v)) for k, x in own.items() for i, v in enumerate(x)], "series_id string, t long, value double")
    got = {(r.series_id, r.check): r.verdict for r in stationarity.stationarity_findings(s).collect()}
    assert got["noise", "adf_test"] == got["walk", "diff_stationarity"] == "PASS" and got["walk", "adf_test"] == got["walk", "kpss_test"] == "WARN"
    assert got["flat", "stationarity"] == got["short", "stationarity"] == "SKIP"
