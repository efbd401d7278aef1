"""Engine and collections: a catalog of vector tables with upsert, delete and search.

A collection is a log of batches over an optional snapshot; reading replays it, last writer
wins.  Methods return plain DataFrames, so filters, joins and SQL go on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.distance import metric_of
from quillon.operators import hnsw, knn
from quillon.operators.log import last_writes, replay, should_compact, upto
from quillon.schema import DELETE, LOG, PUT, VECTOR, Duplicate, EngineError, NotFound, checked
from quillon.sources.files import _place, append_log, has_graph, read_graph, read_log, read_snapshot, truncate_log, write_graph, write_snapshot


class Collection:
    """Vectors of one dimension under one metric."""

    def __init__(self, spark: SparkSession, name: str, dim: int, metric="cosine", seed: int = 1, path: str | None = None):
        if dim <= 0:
            raise EngineError("dimension must be positive")
        metric_of(metric)
        self.spark, self.name, self.dim, self.metric, self.seed, self.path = spark, name, dim, metric, seed, path
        self._log: DataFrame | None = None
        self._lsn = 0
        if path is not None:
            _, self._lsn = read_snapshot(spark, path)
            if (log := self._stored_log()) is not None:
                self._lsn = max(self._lsn, log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0])

    def _stored_log(self) -> DataFrame | None:
        fs, p = _place(self.spark, f"{self.path}/log")
        return read_log(self.spark, f"{self.path}/log") if fs.exists(p) else None

    def log(self) -> DataFrame:
        """All records not yet covered by a snapshot, and perhaps older ones."""
        log = self._stored_log() if self.path is not None else self._log
        return log if log is not None else self.spark.createDataFrame([], LOG)

    def _write(self, rows: DataFrame) -> int:
        self._lsn += 1
        batch = rows.select(F.lit(self._lsn).cast("long").alias("lsn"), "op", "id", "vec")
        if self.path is not None:
            append_log(batch, f"{self.path}/log", segment=1)
        else:
            self._log = batch if self._log is None else self._log.unionByName(batch)
        return self._lsn

    def _rows(self, rows) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], VECTOR)

    def upsert(self, rows) -> int:
        """Writes vectors, replacing those with the same ids; an id may come once a batch.  Returns
        the batch's log number."""
        batch = checked(self._rows(rows).select("id", "vec"), self.dim)
        twice = batch.groupBy("id").agg(F.count("vec").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise EngineError(f"id {twice[0]['id']} comes more than once in a batch")
        return self._write(batch.withColumn("op", F.lit(PUT)))

    def delete(self, ids, missing: str = "error") -> int:
        """Deletes ids; one that isn't there is an error, or nothing with ``missing='ignore'``."""
        gone = ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        if missing == "error":
            absent = gone.join(self.vectors(), "id", "left_anti").limit(1).collect()
            if absent:
                raise NotFound(f"id {absent[0]['id']}")
        return self._write(gone.withColumn("op", F.lit(DELETE)).withColumn("vec", F.lit(None).cast("array<float>")))

    def vectors(self, as_of: int | None = None) -> DataFrame:
        """Live ``(id, vec)``, now or as of a log number not below the snapshot's."""
        snapshot, mark = read_snapshot(self.spark, self.path) if self.path is not None else (None, 0)
        if as_of is not None and as_of < mark:
            raise EngineError(f"the log before {mark} has been compacted")
        log = self.log() if as_of is None else upto(self.log(), as_of)
        return replay(log, snapshot, mark).select("id", "vec")

    def get(self, i: int) -> list[float]:
        found = last_writes(self.log().where(F.col("id") == i)).where(F.col("op") == PUT) if self.path is None else self.vectors().where(F.col("id") == i)
        row = found.select("vec").first()
        if row is None:
            raise NotFound(f"id {i}")
        return list(row[0])

    def ids(self) -> DataFrame:
        return self.vectors().select("id").orderBy("id")

    def count(self) -> int:
        return self.vectors().count()

    def query(self, query: list[float], k: int, as_of: int | None = None) -> DataFrame:
        """``(id, distance)`` of the ``k`` nearest live vectors."""
        if len(query) != self.dim:
            raise EngineError(f"the query has {len(query)} dimensions, the collection {self.dim}")
        return knn.nearest(self.vectors(as_of), query, k, self.metric)

    def query_batch(self, queries: DataFrame, k: int, method: str = "exact", shards: int = 4, params: hnsw.Params | None = None) -> DataFrame:
        """``(q_id, rank, id, distance)`` for queries ``(q_id, q)``: ``exact``, ``sharded`` or ``hnsw``."""
        q = checked(queries.select(F.col("q_id").alias("id"), F.col("q").alias("vec")), self.dim).select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
        live = self.vectors()
        if method == "exact":
            return knn.knn(live, q, k, self.metric) if isinstance(self.metric, str) else knn.knn_by_expression(live, q, k, self.metric)
        if method == "sharded":
            return knn.knn_sharded(live, q, k, self.metric, shards)
        if method == "hnsw" and isinstance(self.metric, str):
            stored = self._index_path(shards, params)
            graph = read_graph(self.spark, stored)[0] if stored is not None and has_graph(self.spark, stored) else hnsw.build(live, shards, self.metric, params)
            return hnsw.search(graph, q, k, self.metric, params)
        raise EngineError(f"unknown method {method!r}")

    def _index_path(self, shards: int, params: hnsw.Params | None) -> str | None:
        """Where the graph of the present state lies, if it has been built; a write makes it another place."""
        p = params or hnsw.Params()
        return None if self.path is None else f"{self.path}/index/{self._lsn:020d}-{shards}-{p.m}-{p.ef_construction}-{p.seed}"

    def build_index(self, shards: int = 4, params: hnsw.Params | None = None) -> str:
        """Stores the graph of the present state; searches with the same settings read it until the next write."""
        path = self._index_path(shards, params)
        if path is None:
            raise EngineError("the collection has no path")
        if not has_graph(self.spark, path):
            write_graph(hnsw.build(self.vectors(), shards, self.metric, params), path, {"lsn": self._lsn, "metric": self.metric, "shards": shards})
        return path

    def checkpoint(self) -> int:
        """Writes a snapshot of everything so far, points the manifest at it, then deletes the log that
        it covers; returns its watermark.  A crash in between leaves more log to replay."""
        if self.path is None:
            raise EngineError("the collection has no path")
        write_snapshot(self.vectors(), self.path, self._lsn)
        truncate_log(self.spark, f"{self.path}/log", self._lsn)
        return self._lsn

    def maybe_checkpoint(self, factor: float = 0.5, floor: int = 1000) -> bool:
        """Writes a snapshot if the log to replay has grown too long."""
        snapshot, mark = read_snapshot(self.spark, self.path)
        sizes = self.log().where(F.col("lsn") > mark).agg(F.count(F.lit(1)).alias("r")).withColumn("s", F.lit(snapshot.count() if snapshot is not None else 0))
        due = sizes.select(should_compact(F.col("r"), F.col("s"), factor, floor)).first()[0]
        if due:
            self.checkpoint()
        return due


class Engine:
    """A catalog of collections."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._collections: dict[str, Collection] = {}

    def create_collection(self, name: str, dim: int, metric="cosine", seed: int = 1, path: str | None = None) -> Collection:
        if name in self._collections:
            raise Duplicate(f"collection {name!r} exists")
        self._collections[name] = made = Collection(self.spark, name, dim, metric, seed, path)
        return made

    def open_collection(self, name: str, dim: int, metric="cosine", seed: int = 1, path: str | None = None) -> Collection:
        """A stored collection: what is there is recovered, and compacted where the log has grown too long."""
        if path is None:
            raise EngineError("a stored collection needs a path")
        opened = self.create_collection(name, dim, metric, seed, path)
        if opened._stored_log() is not None:
            opened.maybe_checkpoint()
        return opened

    def collection(self, name: str) -> Collection:
        if name not in self._collections:
            raise NotFound(f"collection {name!r}")
        return self._collections[name]
