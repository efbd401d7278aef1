"""Inputs of the registered queries, derived from the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship

SEGMENT = 1000
SHARDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def queries_every(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The query set that grows with the table: the vectors whose ids ``n`` divides."""
    return corpus(spark, sf_dir).where(F.col("id") % n == 0).select(F.col("id").alias("q_id"), F.col("vec").alias("q"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutation log of the events: an error deletes the user's vector, anything else writes one."""
    vectors = corpus(spark, sf_dir)
    n = F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n")))  # one row
    events = table(spark, sf_dir, "events").join(n).withColumn("src", F.col("event_id") % F.col("n"))
    both = events.join(vectors.withColumnRenamed("id", "src"), "src")
    is_del = F.col("event_type") == "error"
    return both.select(
        (F.col("event_id") + 1).alias("lsn"),
        F.when(is_del, "del").otherwise("put").alias("op"),
        F.col("user_id").alias("id"),
        F.when(~is_del, F.col("vec")).alias("vec"),
    )


SQL_EMB = "emb AS (SELECT vec_id AS id, embedding AS vec, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
SQL_LOG = """op_log AS (
  SELECT event_id + 1 AS lsn, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, user_id AS id,
         CASE WHEN event_type <> 'error' THEN vec END AS vec
  FROM events JOIN emb ON emb.id = event_id % (SELECT count(*) FROM emb))"""
SQL_MAX = "(SELECT max(lsn) FROM op_log)"


def sql_live(log: str, name: str = "live") -> str:
    return f"""{name} AS (
  SELECT id, vec, lsn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS nth FROM {log}) WHERE nth = 1 AND op = 'put')"""


def half(log: DataFrame) -> int:
    """A watermark in the middle of a log."""
    return log.agg(F.max("lsn")).first()[0] // 2


def manifest_of(log: DataFrame) -> DataFrame:
    """A workload that differs from the log in every way an audit tells apart: some ids unwritten,
    some never logged, one vector component changed, the last writes of some ids uncertain."""
    kept = log.where(F.col("id") % 97 != 5)
    extra = kept.where(F.col("id") % 89 == 3).withColumn("id", F.col("id") + 1_000_000)
    changed = F.when((F.col("id") % 83 == 7) & F.col("vec").isNotNull(), F.transform("vec", lambda x: (x * 2).cast("float"))).otherwise(F.col("vec"))
    rows = kept.withColumn("vec", changed).unionByName(extra)
    return rows.withColumn("standing", F.when(F.col("id") % 71 == 2, "uncertain").otherwise("confirmed"))


SQL_MANIFEST = """manifest AS (
  SELECT lsn, op, id, CASE WHEN id % 83 = 7 THEN list_transform(vec, lambda x: CAST(x * 2 AS FLOAT)) ELSE vec END AS vec,
         CASE WHEN id % 71 = 2 THEN 'uncertain' ELSE 'confirmed' END AS standing
  FROM (SELECT * FROM op_log WHERE id % 97 <> 5) UNION ALL BY NAME
  SELECT lsn, op, id + 1000000 AS id, CASE WHEN id % 83 = 7 THEN list_transform(vec, lambda x: CAST(x * 2 AS FLOAT)) ELSE vec END AS vec,
         CASE WHEN (id + 1000000) % 71 = 2 THEN 'uncertain' ELSE 'confirmed' END AS standing
  FROM op_log WHERE id % 97 <> 5 AND id % 89 = 3)"""


def super_log(log: DataFrame) -> DataFrame:
    """An append log whose indexes are rewound by 7 at every 50th position, under a new term."""
    r = F.floor(F.col("lsn") / 50)
    return log.select(F.col("lsn").alias("pos"), (F.col("lsn") - 7 * r).alias("idx"), r.alias("term"), "op", "id")


def replica(log: DataFrame) -> DataFrame:
    """A second replica's log: the last tenth is lacking, one record differs."""
    top = half(log)
    return log.where(F.col("lsn") <= top * 2 - top // 5).withColumn("id", F.when(F.col("lsn") == top + 3, F.col("id") + 1).otherwise(F.col("id")))
