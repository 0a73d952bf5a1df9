"""Every query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"scope", "dice", "iou", "sample_count"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    good, note = compare(spark, duck, name, QUERIES[name], SQL.get(name), SF)
    spark.catalog.clearCache()
    assert good, note
