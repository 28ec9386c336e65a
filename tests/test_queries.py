"""Every registered query at the smallest scale, next to its SQL."""

import pytest

import __spark_entry__ as entry
from check import DATA, difference, oracle_connection

FOLDER = str(DATA / "sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="the provided tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(FOLDER)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).columns == [
        "article_url", "press_release_url", "contradiction", "entailment", "neutral", "rank",
    ]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        assert difference(got, duck.execute(ORACLE[name]).df()) is None
