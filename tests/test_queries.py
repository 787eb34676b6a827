"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

from tidewright import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v + 0:.5g}"
    return str(v)


def same(spark, f, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    rel = con.sql(sql)
    got = f(spark, sf_dir)
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [rel.columns.index(c) for c in names]
    b = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(close(p, q) for p, q in zip(x, y, strict=True))]
    assert not wrong, wrong[:3]


def close(p, q):
    try:
        return p == q or math.isclose(float(p), float(q), rel_tol=1e-4, abs_tol=1e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(spark, plans.QUERIES[name], plans.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir.replace("0.001", "0.01")).count() > 0


def test_runge_kutta_ties_as_in_sql(spark, tmp_path):
    """To the last of six digits, also where x lies half way between two: scenarios 5, 25, 65, 85, 125, 145, 185 after a step, 95 after two."""
    import duckdb

    duckdb.sql(f"COPY (SELECT range AS n_nationkey, range % 5 AS n_regionkey FROM range(200)) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    sql = duckdb.sql(plans.SQL["sd_rk4"].replace("FROM nation", f"FROM '{tmp_path}/nation.parquet'")).fetchall()
    got = plans.QUERIES["sd_rk4"](spark, str(tmp_path)).select("scenario", "step", "t", "state", "x").collect()
    assert sorted(map(tuple, got)) == sorted(sql)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["series_id", "phase_no", "phase", "check", "verdict", "severity", "value"] and df.count() > 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
