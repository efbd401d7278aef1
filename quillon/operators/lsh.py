"""Approximate Euclidean search by random projections: an extension, for corpora without a graph."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.distance import l2_distance
from quillon.operators.knn import merge_topk


def search(corpus: DataFrame, queries: DataFrame, k: int, radius: float, bucket: float = 1.0, tables: int = 8, seed: int = 7) -> DataFrame:
    """``(q_id, rank, id, distance)`` among vectors that share a bucket with the query and lie within ``radius``."""
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed)
    left = queries.select("q_id", "q", array_to_vector(F.col("q").cast("array<double>")).alias("_v"))
    right = corpus.select("id", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("_v"))
    pairs = model.fit(right).approxSimilarityJoin(left, right, radius, "_d")
    found = pairs.select("datasetA.q_id", "datasetB.id", l2_distance(F.col("datasetA.q"), F.col("datasetB.vec")).alias("distance"))
    return merge_topk(found, k, ["q_id"]).select("q_id", "rank", "id", "distance")
