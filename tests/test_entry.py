"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.catalog import all_queries
from checks.compare import duck_rows, spark_rows
from checks.oracles import all_statements

FOLDER = "/root/testdata/sf0.001"


def test_entry(compiled_spark):
    df = entry.entry(compiled_spark)
    assert df.count() == 1
    assert "assessment" in df.columns


def test_names():
    assert all_queries().keys() == all_statements().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(compiled_spark, name):
    assert spark_rows(entry.queries()[name](compiled_spark, FOLDER)) == duck_rows(FOLDER, entry.oracle_sql()[name])
