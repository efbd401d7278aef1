"""op1: document fingerprints.  SQL can't express the sketches; tests use brute force."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.fingerprints import edited_pairs


def op1_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bottom_k_fingerprints": op1_bottom_k_fingerprints}
SQL: dict[str, str] = {}
