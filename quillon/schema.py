"""Data model: vectors, neighbours, mutation logs; validity of vectors.

A vector is ``(id LONG, vec ARRAY<FLOAT>)``; ids are unsigned 64-bit numbers in two's complement.
A collection's only schema is the dimension of its vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

VECTOR = StructType([StructField("id", LongType(), False), StructField("vec", ArrayType(FloatType()), False)])
NEIGHBOR = StructType([StructField("q_id", LongType()), StructField("rank", IntegerType()), StructField("id", LongType()), StructField("distance", FloatType())])
LOG = StructType([StructField("lsn", LongType()), StructField("op", StringType()), StructField("id", LongType()), StructField("vec", ArrayType(FloatType()))])

PUT, DELETE = "put", "del"


class EngineError(ValueError):
    """A request that the engine refuses."""


class NotFound(EngineError):
    """The id isn't there."""


class Duplicate(EngineError):
    """The name is taken."""


def is_finite(vec: Column) -> Column:
    """No component is NaN or infinite."""
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | x.isNull())
    return ~bad


def is_valid(vec: Column, dim: int | None = None) -> Column:
    """Not empty, finite, and of the given dimension; null vectors aren't valid."""
    ok = vec.isNotNull() & (F.size(vec) > 0) & is_finite(vec)
    return F.coalesce(ok & (F.size(vec) == dim) if dim is not None else ok, F.lit(False))


def defect(vec: Column, dim: int | None = None) -> Column:
    """Why a vector isn't valid: ``empty``, ``non-finite``, ``dimension``; null if it is."""
    wrong = F.when(vec.isNull() | (F.size(vec) <= 0), F.lit("empty")).when(~is_finite(vec), F.lit("non-finite"))
    return wrong.when(F.size(vec) != dim, F.lit("dimension")) if dim is not None else wrong


def split_valid(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with a ``defect`` column."""
    marked = vectors.withColumn("defect", defect(F.col("vec"), dim))
    return marked.where("defect IS NULL").drop("defect"), marked.where("defect IS NOT NULL")


def checked(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``vectors``, failing at run time at the first invalid one."""
    why = defect(F.col("vec"), dim)
    said = F.concat(F.lit("invalid vector "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(": "), why)
    return vectors.withColumn("vec", F.when(why.isNotNull(), F.raise_error(said).cast("array<float>")).otherwise(F.col("vec")))
