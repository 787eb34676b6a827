"""Registered queries of the folder, and their SQL."""

import pytest

from tests.test_queries import same
from tidewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11))
