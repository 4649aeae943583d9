import pytest

from evenkeel.plans import registry
from tests.oracle import expected, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    got = registry.queries()[name](spark, FOLDER)
    want, columns = expected(registry.oracle_sql()[name], FOLDER)
    assert sorted(got.columns) == columns
    assert rows_of(got) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_is_repeatable(spark, name):
    first, second = (rows_of(registry.queries()[name](spark, FOLDER)) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 32832 and df.filter("is_real").count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
