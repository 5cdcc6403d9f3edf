"""Every registered query of the engine against its DuckDB form."""

import pytest

from geoloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck.execute(ORACLES[name]))


def test_without_oracle(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
