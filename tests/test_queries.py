"""Every query that has SQL gives the SQL's rows; the others run and give rows."""

import pytest
from helpers import rows_of, sql_rows

from orderflow.jobs import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert rows_of(registry.queries()[name](spark, FOLDER)) == sql_rows(SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert "kind" in __spark_entry__.entry(spark).columns
