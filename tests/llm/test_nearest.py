import numpy as np
import pytest

from tidewright.llm import nearest as module
from tidewright.llm.nearest import CERTAINTY, DIMENSIONS, Cells, Index, chi2_cdf, chi2_quantile, nearest, projection, unit


def brute(rows, queries, k=5):
    out = {}
    fit = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in fit]), np.array([v for _, v in fit])
    for i, v in queries:
        v = np.array(v, float)
        cos = x @ v / np.sqrt((x * x).sum(1)) / np.sqrt(v @ v)
        order = sorted((-round(c, 12), int(j)) for c, j in zip(cos, ids, strict=True) if j != i)[:k]
        out[i] = [(j, -c) for c, j in order]
    return out


def test_recall_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    queries = [(i, v) for i, v in rows if i % 50 == 0]
    want = brute(rows, queries)
    got = {}
    for r in sorted(nearest(table, table.where("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * 5 * len(want)
    vec = dict(rows)
    for q, hits in got.items():
        for i, s in hits:
            a, b = np.array(vec[q], float), np.array(vec[i], float)
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-14)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, []), (None, [1.0, 0.0]), (50, [0.6, 0.8]), (100, [1.0, 2.0, 3.0]), (150, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = nearest(table, table.where("vec_id % 50 = 0")).collect()
    two = [r for r in rows if r[1] and len(r[1]) == 2]
    want = brute(two, [(0, [1.0, 0.0]), (50, [0.6, 0.8])])
    for q in (0, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == [i for i, _ in want[q]]
    assert {r.query_id for r in got} == {0, 50}
    assert nearest(table.limit(0), table.limit(0)).collect() == []


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 8) for i in range(400)] + [(i, rng.standard_normal(8).tolist()) for i in range(400, 900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nearest(table, table.where("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_cells_reached_are_those_within_the_limit():
    rng = np.random.default_rng(3)
    points = rng.standard_normal((3000, 4))
    cells = Cells(points, 6)
    queries, limit = rng.standard_normal((40, 4)), rng.uniform(0.0, 1.0, 40)
    q, cell = cells.reached(queries, limit)
    assert len(set(zip(q.tolist(), cell.tolist(), strict=True))) == len(q)
    got, home = set(zip(q.tolist(), cell.tolist(), strict=True)), cells.of(points)
    assert all((i, c) in got for i, c in enumerate(cells.of(queries).tolist()))
    for i, x in enumerate(queries):
        near = np.flatnonzero(((points - x) ** 2).sum(axis=1) <= limit[i])
        assert all((i, int(c)) in got for c in home[near])
    assert len(got) < 40 * 64


def test_chi_square():
    x = np.array([0.5, 3.0, 10.0, 40.0])
    assert chi2_cdf(x, 2) == pytest.approx(1 - np.exp(-x / 2))
    assert chi2_cdf(np.array([chi2_quantile(0.9, 7)]), 7)[0] == pytest.approx(0.9)


def many(n, seed=7):
    """Vectors without any structure, the hardest to tell apart."""
    return np.random.default_rng(seed).standard_normal((n, 64))


def test_recall_over_many_cells(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = many(52_000)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    table = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = {}
    for r in nearest(table, table.where("vec_id % 500 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x / np.sqrt((x * x).sum(1))[:, None]
    found = 0
    for q in range(0, len(x), 500):
        cos = y @ y[q]
        cos[q] = -2
        found += len(got[q] & set(np.argpartition(-cos, 5)[:5].tolist()))
    assert found >= 0.9 * 5 * len(got) and len(got) == 104


def test_the_stopping_test_stops():
    x = many(50_000)
    spread, limit = projection(64), chi2_quantile(CERTAINTY, DIMENSIONS)
    index, points = Index(x, spread), unit(x[:50]) @ spread
    verified = [index.search(x[i], points[i], 6, 8.0, limit)[2] for i in range(50)]
    assert np.mean(verified) < 0.45 * len(x)


def test_cells_in_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL", 40)
    monkeypatch.setattr(module, "SAMPLE", 64)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)
