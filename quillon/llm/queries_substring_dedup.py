"""op5: suffix-array dedup.

SQL over every string of 100 bytes is too slow on whole tables; tests hold the query against
brute force.
"""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.substring_dedup import digests


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
SQL: dict[str, str] = {}
