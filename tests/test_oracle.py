"""Every query of the engine against its SQL over the same tables."""

from __future__ import annotations

import pytest
from tremorscope.plans.queries import oracle_sql, queries


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(name, spark, small, duck, rows_of):
    assert rows_of(queries()[name](spark, small).toPandas()) == rows_of(duck.sql(oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
