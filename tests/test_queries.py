"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    columns, rows = compare.spark_rows(queries()[name](spark, SF_DIR))
    want_columns, want, _ = compare.duck_rows(duck, oracle_sql()[name])
    assert columns == want_columns
    assert rows == want


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql_or_a_fixture_test():
    own = {name for name in queries() if not name.startswith("op") and name != "pipeline"}
    assert own - set(oracle_sql()) == {"search_snippets"}
