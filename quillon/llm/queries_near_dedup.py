"""op7: MinHash near-dedup with odd sketches.

SQL can't express the sketches; tests hold the groups against all pairs of exact sets.
"""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.near_dedup import grouped


def op7_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op7_odd_sketch_near_dedup": op7_odd_sketch_near_dedup}
SQL: dict[str, str] = {}
