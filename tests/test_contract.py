"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.contract import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) & set(entry_points.oracle_sql())))
def test_query_equals_its_oracle(spark, tables, name):
    sql = entry_points.oracle_sql()[name]
    assert differences(spark, tables, entry_points.queries()[name], sql, SF) is None


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
