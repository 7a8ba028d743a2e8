"""Every query of the library against its SQL, and the entry points' contract."""

import __spark_entry__
import pytest
from lexspark.plans import catalog, oracles


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck, same):
    same(catalog.queries()[name](spark, sf).toPandas(), duck.execute(oracles.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() >= 0


def test_sql_has_its_query():
    assert set(oracles.SQL) <= set(catalog.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
