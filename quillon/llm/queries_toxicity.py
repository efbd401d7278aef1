"""op2: toxicity.  SQL can't express the segments; tests measure held-out accuracy."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.toxicity import fit, scored


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = scored(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxic_segments": op2_toxic_segments}
SQL: dict[str, str] = {}
