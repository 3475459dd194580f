"""Every query against its SQL, and those without SQL for stable, non-empty results, over whole tables."""

import pytest
from conftest import DATA, assert_same, duck

from lamina.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
