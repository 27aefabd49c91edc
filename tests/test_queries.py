"""Every registered query with SQL gives the SQL's rows."""

import pytest

from corpusmill.plans import registry

from .oracle import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    sf = DATA / "sf0.001"
    assert spark_rows(registry.queries()[name](spark, str(sf))) == sql_rows(registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA / "sf0.001")).columns
