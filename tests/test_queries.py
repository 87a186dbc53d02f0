import pytest

from stridecast.plans import catalog
from tests.compare import same_rows

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    same_rows(spark, catalog.queries()[name], SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
