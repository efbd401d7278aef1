"""Exact k-nearest-neighbour search, partial and final top-k, recall and shape checks.

Results are ordered by distance, then id.  The corpus stays where it is; queries go to it in
blocks of bounded size, each task keeps its own best k a query, and only those are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distance import METRICS, Metric, distances, metric_of
from quillon.functions.hashing import shard_for
from quillon.schema import EngineError
from quillon.session import ship

#: Query bytes that are sent to the executors at once; more queries go in several blocks.
QUERY_BYTES = 32 << 20
#: Distances a kernel holds at once.
CELLS = 1 << 20
#: Rows of a kernel's result that are sent on at once, about.
ROWS_OUT = 10_000


def _top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` a group by (distance, id); the limit goes below the shuffle."""
    order = Window.partitionBy(*by).orderBy("distance", "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _check(k: int) -> None:
    if k <= 0:
        raise EngineError("k must be positive")


def nearest(corpus: DataFrame, query: list[float], k: int, metric: str | Metric = "cosine") -> DataFrame:
    """``(id, distance)`` of the ``k`` vectors nearest to one query: no join, one ordered limit."""
    _check(k)
    if not query or not np.isfinite(query).all():
        raise EngineError("the query must be finite and not empty")
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<float>")
    return corpus.select("id", metric_of(metric)(q, F.col("vec")).alias("distance")).orderBy("distance", "id").limit(k)


def knn_by_expression(corpus: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "cosine") -> DataFrame:
    """``(q_id, rank, id, distance)`` with any metric given as an expression.

    Queries are held against all vectors in blocks that fit ``QUERY_BYTES``.  A metric given by name
    has a kernel that finds the same best ``k``: the expression then measures only what it found, and
    all pairs with rows that the kernel doesn't take.  An expression of the caller's measures all pairs.
    """
    _check(k)
    measure = metric_of(metric)
    told = lambda pairs: pairs.select("q_id", "id", measure(F.col("q"), F.col("vec")).alias("distance"))
    parts = None
    for block in _query_blocks(queries):
        if callable(metric):
            part = _top(told(corpus.crossJoin(F.broadcast(block))), ["q_id"], k)  # a stated query set against all rows, in blocks
        else:
            found, rows, asked, odd = _found(corpus, block, k, metric)
            best = _top(found, ["q_id"], k).select("q_id", "id").distinct()
            part = _top(told(best.join(rows, "id").join(asked, "q_id")).union(told(odd)), ["q_id"], k)
        parts = part if parts is None else parts.union(part)
    return parts.select("q_id", "rank", "id", "distance")


def _found(corpus: DataFrame, block: DataFrame, k: int, metric: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The kernel's best ``k`` of each task, over rows and queries that have finite vectors of one
    length; these rows and queries; the other pairs of ``corpus`` and ``block``, of which there are few."""
    ship(corpus.sparkSession)
    n = (block.select(F.size("q")).first() or [0])[0]
    plain = lambda v: F.coalesce((F.size(v) == n) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    rows, asked = corpus.where(plain(F.col("vec"))), block.where(plain(F.col("q")))
    found = _kernel(rows, asked.select("q_id", "q").toArrow(), k, metric)  # QUERY_BYTES at most
    odd_queries = corpus.crossJoin(F.broadcast(block.where(~plain(F.col("q")))))
    odd_rows = corpus.where(~plain(F.col("vec"))).crossJoin(F.broadcast(asked))
    return found, rows, asked, odd_queries.unionByName(odd_rows)


def _query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of at most about ``QUERY_BYTES``."""
    size = queries.agg(F.coalesce(F.sum(4 * F.size("q") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // QUERY_BYTES))
    if n == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == i) for i in range(n)]


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``(q_id, rank, id, distance)``: exact search by an Arrow kernel.

    Distances equal those of the expressions bit for bit, as sums run in the same order.
    """
    _check(k)
    if metric not in METRICS:
        raise EngineError(f"unknown metric {metric!r}")
    ship(corpus.sparkSession)
    parts = None
    for block in _query_blocks(queries):
        found = block.select("q_id", "q").toArrow()  # QUERY_BYTES at most
        part = _kernel(corpus.select("id", "vec"), found, k, metric)
        parts = part if parts is None else parts.union(part)
    return _top(parts, ["q_id"], k).select("q_id", "rank", "id", "distance")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a float matrix."""
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), dtype=np.float32)
    return values.reshape(n, -1) if n else np.empty((0, 0), np.float32)


def _best(ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least by (distance, id)."""
    if len(row) > 4 * k:
        limit = np.partition(row, k - 1)[k - 1]
        at = np.flatnonzero(row <= limit)
    else:
        at = np.arange(len(row))
    return at[np.lexsort((ids[at], row[at]))[:k]]


def _kernel(corpus: DataFrame, queries: pa.Table, k: int, metric: str) -> DataFrame:
    """``(q_id, id, distance)``: the best ``k`` of each query in each task; of each shard too, which is
    told then, where the corpus has a column of that name."""
    q_ids = queries.column("q_id").to_numpy()
    q = matrix(queries.column("q"))

    sharded = "shard" in corpus.columns

    def legs(batch):
        ids, c = batch.column(0).to_numpy(), matrix(batch.column(1))
        if not sharded:
            yield 0, ids, c
            return
        shards = batch.column(2).to_numpy()
        for s in np.unique(shards).tolist():
            yield s, ids[shards == s], c[shards == s]

    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for s, ids, c in (leg for batch in batches for leg in legs(batch)):
            if not len(ids):
                continue
            if len(q) and c.shape[1] != q.shape[1]:
                raise EngineError(f"queries have {q.shape[1]} dimensions, vectors {c.shape[1]}")
            step = max(1, CELLS // len(ids))
            for i in range(0, len(q), step):
                d = distances(q[i : i + step], c, metric)
                for j, row in enumerate(d, i):
                    have = held.get((s, j))
                    all_ids, all_d = (ids, row) if have is None else (np.concatenate([have[0], ids]), np.concatenate([have[1], row]))
                    at = _best(all_ids, all_d, k)
                    held[s, j] = all_ids[at], all_d[at]
        keys = sorted(held)
        for begin in range(0, len(keys), ROWS_OUT // k + 1):
            some = keys[begin : begin + ROWS_OUT // k + 1]
            n = [len(held[x][0]) for x in some]
            columns = {
                "q_id": pa.array(np.repeat([q_ids[j] for _, j in some], n), pa.int64()),
                "shard": pa.array(np.repeat([s for s, _ in some], n), pa.int32()),
                "id": pa.array(np.concatenate([held[x][0] for x in some]), pa.int64()),
                "distance": pa.array(np.concatenate([held[x][1] for x in some]), pa.float32()),
            }
            yield pa.RecordBatch.from_pydict({c: x for c, x in columns.items() if sharded or c != "shard"})

    return corpus.select("id", "vec", *["shard"] * sharded).mapInArrow(run, f"q_id long, {'shard int, ' * sharded}id long, distance float")


def merge_topk(lists: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Lists of ``(id, distance)`` merged to the best ``k``, a query where ``by`` names one."""
    if k <= 0:
        return lists.limit(0)
    if not by:
        return lists.orderBy("distance", "id").limit(k)
    return _top(lists, by, k)


def knn_sharded(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", shards: int = 4) -> DataFrame:
    """Search as a sharded service does it: the best ``k`` of each shard, then of all.

    The result is that of :func:`knn`, as any vector of the whole's best k is of its shard's best k.
    """
    _check(k)
    measure = metric_of(metric)
    placed = corpus.withColumn("shard", shard_for(F.col("id"), shards))
    parts = None
    for block in _query_blocks(queries):
        found, *_, pairs = (None, placed.crossJoin(F.broadcast(block))) if callable(metric) else _found(placed, block, k, metric)
        pairs = pairs.select("q_id", "shard", "id", measure(F.col("q"), F.col("vec")).alias("distance"))
        legs = _top(pairs if found is None else found.union(pairs), ["q_id", "shard"], k).drop("rank")
        parts = legs if parts is None else parts.union(legs)
    return merge_topk(parts, k, ["q_id"]).select("q_id", "rank", "id", "distance")


def unreachable(corpus: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(q_id, id, distance)`` of vectors that aren't their own nearest neighbour.

    Of exact duplicates only the one with the least id is; they are reported, not an error.  Under
    l2 nothing else is nearer to a vector than its duplicates, so these are grouped and no pairs
    are made; other metrics need a search of all vectors.
    """
    if metric == "l2":
        homes = corpus.groupBy("vec").agg(F.min("id").alias("_home"))
        found = corpus.join(homes, "vec").where(F.col("id") > F.col("_home"))
        return found.select(F.col("id").alias("q_id"), F.col("_home").alias("id"), F.lit(0.0).cast("float").alias("distance"))
    found = knn(corpus, corpus.select(F.col("id").alias("q_id"), F.col("vec").alias("q")), 1, metric)
    return found.where("q_id <> id").select("q_id", "id", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(hits, expected, recall)`` of one result against the exact one."""
    hits = exact.select("q_id", "id").join(found.select("q_id", "id").withColumn("_hit", F.lit(1)), ["q_id", "id"], "left")
    return hits.agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("expected")).withColumn("recall", F.col("hits") / F.col("expected"))


def shape_defects(found: DataFrame, live: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries whose result isn't min(k, live) different live ids: ``(q_id, n, n_distinct, n_dead)``."""
    n = live.count()
    marked = found.join(live.select("id").withColumn("_live", F.lit(1)), "id", "left")
    each = marked.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"), F.sum(F.when(F.col("_live").isNull(), 1).otherwise(0)).alias("n_dead"))
    out = queries.select("q_id").join(each, "q_id", "left").fillna(0, ["n", "n_distinct", "n_dead"])
    return out.where((F.col("n") != min(k, n)) | (F.col("n_distinct") != F.col("n")) | (F.col("n_dead") > 0))
