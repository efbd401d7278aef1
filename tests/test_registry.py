import pytest

from oracle import same
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_entry_runs(spark):
    import __spark_entry__ as e

    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert asked > 0 and e.entry(spark).count() == 10 * asked
    assert set(registry.queries()) <= set(e.queries())
