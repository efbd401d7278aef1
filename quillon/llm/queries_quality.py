"""op8: quality rules by hashed n-gram log-likelihood ratio.

The hash of the features is Spark's own, so DuckDB can't repeat the verdict: no SQL oracle.
Tests hold the counts against plain Python and the ratios against a brute-force model.
"""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.quality import fit, judged


def op8_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_llr": op8_quality_llr}
SQL: dict[str, str] = {}
