"""Registry of the engine's queries and of the SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.distance import norm
from quillon.functions.hashing import shard_for, splitmix64
from quillon.functions.vectors import neighbor_line, parse_vector
from quillon.operators import audit, hnsw, knn, log
from quillon.plans import fixtures as fx
from quillon.schema import defect, is_valid
from quillon.sources.files import append_log, gaussian, parse_manifest, point_lookup, read_graph, read_log, read_snapshot, truncate_log, uncompacted_log, write_graph, write_snapshot
from quillon.streaming import apply

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


#: Queries are the vectors whose ids this divides.
EVERY = 50
K = 10


def _told(found: DataFrame) -> DataFrame:
    return found.select("q_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), (F.round(F.col("distance").cast("double"), 6) + 0.0).alias("dist"))


_DISTANCE = {
    "cosine": "CASE WHEN a.nn = 0 OR b.nn = 0 THEN 1 ELSE 1 - list_inner_product(a.e, b.e) / (a.nn * b.nn) END",
    "l2": "list_distance(a.e, b.e)",
    "dot": "list_inner_product(a.e, b.e)",
}


_EVERY = f"a.id % {EVERY} = 0"


def _knn_sql(metric: str, queries: str, k: int, source: str = "emb") -> str:
    return f"""
WITH {fx.SQL_EMB},
m AS (SELECT *, sqrt(list_inner_product(e, e)) AS nn FROM {source}),
p AS (SELECT a.id AS q_id, b.id AS vec_id, CAST({_DISTANCE[metric]} AS FLOAT) AS d FROM m a, m b WHERE {queries}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS rank FROM p)
SELECT q_id, CAST(rank AS INT) AS rank, vec_id, round(CAST(d AS DOUBLE), 6) + 0.0::DOUBLE AS dist FROM r WHERE rank <= {k}"""


# --- search -------------------------------------------------------------------------------------


@_query(_knn_sql("cosine", _EVERY, K))
def knn_cosine_exact(spark, sf_dir):
    return _told(knn.knn(fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), K, "cosine"))


@_query(_knn_sql("l2", _EVERY, K))
def knn_l2_exact(spark, sf_dir):
    return _told(knn.knn(fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), K, "l2"))


@_query(_knn_sql("dot", _EVERY, K))
def knn_dot_exact(spark, sf_dir):
    """Ascending by the product, so the least alike come first."""
    return _told(knn.knn(fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), K, "dot"))


@_query(_knn_sql("cosine", _EVERY, K))
def knn_by_expression(spark, sf_dir):
    return _told(knn.knn_by_expression(fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), K, "cosine"))


@_query(_knn_sql("l2", "a.id = 0", K))
def knn_single_query(spark, sf_dir):
    c = fx.corpus(spark, sf_dir)
    q = list(c.where("id = 0").first()["vec"])
    found = knn.nearest(c, q, K, "l2")
    from pyspark.sql import Window

    return _told(found.withColumn("q_id", F.lit(0).cast("long")).withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))))  # K rows


@_query(_knn_sql("l2", _EVERY, 1_000_000))
def knn_k_exceeds_n(spark, sf_dir):
    return _told(knn.knn(fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), 1_000_000, "l2"))


@_query(_knn_sql("cosine", _EVERY, K))
def knn_sharded_merge(spark, sf_dir):
    return _told(knn.knn_sharded(fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), K, "cosine", 7))


@_query(
    f"""
WITH {fx.SQL_EMB}, n AS (SELECT count(*) AS n FROM emb)
SELECT q_id, least({K}, n) AS n, least({K}, n) AS n_distinct FROM (SELECT id AS q_id FROM emb WHERE id % {EVERY} = 0), n"""
)
def knn_result_shape(spark, sf_dir):
    c, q = fx.corpus(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY)
    found = knn.knn(c, q, K, "cosine").join(c.select("id"), "id", "left_semi")
    return found.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"))


@_query(
    f"""
WITH {fx.SQL_EMB},
f AS (SELECT vec, min(id) AS home FROM emb GROUP BY vec)
SELECT emb.id AS q_id, f.home AS vec_id FROM emb JOIN f USING (vec) WHERE emb.id <> f.home"""
)
def self_reachability(spark, sf_dir):
    """Vectors that don't find themselves first: under L2 just the later ones of exact duplicates."""
    return knn.unreachable(fx.corpus(spark, sf_dir), "l2").select("q_id", F.col("id").alias("vec_id"))


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live("op_log")},
m AS (SELECT id, CAST(vec AS DOUBLE[]) AS e FROM live),
q AS (SELECT id, e FROM emb WHERE id % {EVERY} = 0),
p AS (SELECT q.id AS q_id, m.id AS vec_id, CAST(list_distance(q.e, m.e) AS FLOAT) AS d FROM q, m),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS rank FROM p)
SELECT q_id, CAST(rank AS INT) AS rank, vec_id, round(CAST(d AS DOUBLE), 6) + 0.0::DOUBLE AS dist FROM r WHERE rank <= {K}"""
)
def knn_after_replay(spark, sf_dir):
    live = log.replay(fx.op_log(spark, sf_dir)).select("id", "vec")
    return _told(knn.knn(live, fx.queries_every(spark, sf_dir, EVERY), K, "l2"))


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, prefix AS (SELECT * FROM op_log WHERE lsn <= {fx.SQL_MAX} // 2), {fx.sql_live("prefix")},
m AS (SELECT id, CAST(vec AS DOUBLE[]) AS e FROM live),
q AS (SELECT id, e FROM emb WHERE id % {EVERY} = 0),
p AS (SELECT q.id AS q_id, m.id AS vec_id, CAST(list_distance(q.e, m.e) AS FLOAT) AS d FROM q, m),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS rank FROM p)
SELECT q_id, CAST(rank AS INT) AS rank, vec_id, round(CAST(d AS DOUBLE), 6) + 0.0::DOUBLE AS dist FROM r WHERE rank <= {K}"""
)
def knn_linearizable_read(spark, sf_dir):
    """Search of the state as of a log number: every write up to it, none after it."""
    ops = fx.op_log(spark, sf_dir)
    live = log.replay(log.upto(ops, fx.half(ops))).select("id", "vec")
    return _told(knn.knn(live, fx.queries_every(spark, sf_dir, EVERY), K, "l2"))


@_query(
    f"""
WITH {fx.SQL_EMB}, l(list_no, id, distance) AS (SELECT CAST(id % 3 AS INT), id, CAST(e[1] AS FLOAT) FROM emb)
SELECT id AS vec_id, round(CAST(distance AS DOUBLE), 6) AS dist FROM l ORDER BY distance, id LIMIT 25"""
)
def merge_sorted_lists(spark, sf_dir):
    lists = fx.corpus(spark, sf_dir).select((F.col("id") % 3).cast("int").alias("list_no"), "id", F.get("vec", F.lit(0)).alias("distance"))
    legs = knn.merge_topk(lists, 25, ["list_no"]).drop("rank")
    return knn.merge_topk(legs, 25).select(F.col("id").alias("vec_id"), F.round(F.col("distance").cast("double"), 6).alias("dist"))


@_query(
    f"""
WITH {fx.SQL_EMB}, d AS (SELECT id, CAST(list_distance(e, (SELECT e FROM emb WHERE id = 0)) AS FLOAT) AS d FROM emb ORDER BY d, id LIMIT 5)
SELECT id AS vec_id, 'id=' || id || ' dist=' || regexp_replace(CAST(d AS VARCHAR), '\\.0$', '') AS line FROM d"""
)
def result_lines(spark, sf_dir):
    c = fx.corpus(spark, sf_dir)
    found = knn.nearest(c, list(c.where("id = 0").first()["vec"]), 5, "l2")
    return found.select(F.col("id").alias("vec_id"), neighbor_line(F.col("id"), F.col("distance")).alias("line"))


_PARAMS = hnsw.Params()


def _graph(spark, sf_dir, shards=4):
    return hnsw.build(fx.corpus(spark, sf_dir), shards, "cosine", _PARAMS)


@_query()
def hnsw_search(spark, sf_dir):
    return _told(hnsw.search(_graph(spark, sf_dir), fx.queries_every(spark, sf_dir, EVERY), K, "cosine", _PARAMS))


@_query(f"SELECT CAST(count(*) FILTER (vec_id % {EVERY} = 0) * {K} AS BIGINT) AS expected, true AS recall_ok FROM embeddings")
def hnsw_recall(spark, sf_dir):
    q = fx.queries_every(spark, sf_dir, EVERY)
    found = hnsw.search(_graph(spark, sf_dir), q, K, "cosine", _PARAMS)
    got = knn.recall(found, knn.knn(fx.corpus(spark, sf_dir), q, K, "cosine"))
    return got.select("expected", (F.col("recall") >= 0.95).alias("recall_ok"))


@_query("SELECT CAST(0 AS BIGINT) AS n_bad")
def hnsw_graph_symmetry(spark, sf_dir):
    return hnsw.asymmetric_edges(_graph(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_bad"))


@_query()
def hnsw_entry_points(spark, sf_dir):
    return hnsw.entry_point(_graph(spark, sf_dir))


@_query("SELECT vec_id AS id, 'none' AS side FROM embeddings WHERE false")
def hnsw_index_set(spark, sf_dir):
    return audit.set_difference(_graph(spark, sf_dir), fx.corpus(spark, sf_dir))


@_query(
    """
SELECT 'nodes' AS check, count(*) FILTER (vec_id % 10 <> 3) AS n FROM embeddings
UNION ALL SELECT unnest(['one-sided links', 'links to nowhere', 'nodes over a cap', 'recall below 0.95']), 0"""
)
def hnsw_delete_repair(spark, sf_dir):
    """A tenth of a stored graph is deleted, its neighbourhoods are repaired, and what is left is audited."""
    path, shards = work_dir(spark), 4
    write_graph(_graph(spark, sf_dir, shards), f"{path}/before", {"shards": shards})
    vectors = fx.corpus(spark, sf_dir)
    gone = vectors.where(F.col("id") % 10 == 3).select("id")
    write_graph(hnsw.delete(read_graph(spark, f"{path}/before")[0], gone, shards, "cosine", _PARAMS), f"{path}/after", {"shards": shards})
    after = read_graph(spark, f"{path}/after")[0]
    q = fx.queries_every(spark, sf_dir, EVERY)
    got = knn.recall(hnsw.search(after, q, K, "cosine", _PARAMS), knn.knn(vectors.where(F.col("id") % 10 != 3), q, K, "cosine"))
    over = F.exists(F.transform("neighbors", lambda x, layer: F.size(x) > F.when(layer == 0, _PARAMS.cap(0)).otherwise(_PARAMS.cap(1))), lambda x: x)
    counted = {
        "nodes": after,
        "one-sided links": hnsw.asymmetric_edges(after),
        "links to nowhere": hnsw.edges(after).join(after.select(F.col("id").alias("b")), "b", "left_anti"),
        "nodes over a cap": after.where(over),
        "recall below 0.95": got.where("recall < 0.95"),
    }
    out = None
    for check, rows in counted.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- scalars, scans, shards ---------------------------------------------------------------------


@_query(f"WITH {fx.SQL_EMB} SELECT id AS vec_id, round(CAST(CAST(sqrt(list_inner_product(e, e)) AS FLOAT) AS DOUBLE), 6) AS norm FROM emb")
def vector_norms(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(norm(F.col("vec")).cast("double"), 6).alias("norm"))


@_query("SELECT len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dims(spark, sf_dir):
    return fx.corpus(spark, sf_dir).groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    """
SELECT vec_id, vec_id % 5 = 0 AND len(embedding) = 64 AS ok,
       CASE vec_id % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'non-finite' WHEN 3 THEN 'non-finite' WHEN 4 THEN 'dimension' END AS why
FROM embeddings"""
)
def vector_validity(spark, sf_dir):
    """Four of five vectors are spoilt: emptied, NaN or infinite in a place, one component short."""
    v, r = F.col("vec"), F.col("id") % 5
    spoilt = (
        F.when(r == 1, F.array().cast("array<float>"))
        .when(r == 2, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(v, 2, 63)))
        .when(r == 3, F.concat(F.array(F.lit(float("-inf")).cast("float")), F.slice(v, 2, 63)))
        .when(r == 4, F.slice(v, 1, 63))
        .otherwise(v)
    )
    rows = fx.corpus(spark, sf_dir).withColumn("vec", spoilt)
    return rows.select(F.col("id").alias("vec_id"), is_valid(F.col("vec"), 64).alias("ok"), defect(F.col("vec"), 64).alias("why"))


@_query(f"WITH {fx.SQL_EMB} SELECT id AS vec_id, round(e[1], 6) AS v0 FROM emb WHERE id = 17")
def vector_point_lookup(spark, sf_dir):
    return point_lookup(fx.corpus(spark, sf_dir), 17).select(F.col("id").alias("vec_id"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("v0"))


@_query("SELECT count(*) AS n FROM embeddings")
def vector_count(spark, sf_dir):
    return fx.corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT vec_id FROM embeddings ORDER BY vec_id")
def index_id_scan(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select(F.col("id").alias("vec_id")).orderBy("vec_id")


def _mixed_sql(source: str) -> str:
    return f"""
WITH mk AS (SELECT 18446744073709551615::UHUGEINT AS m),
a AS (SELECT i, (i::UHUGEINT + 11400714819323198485::UHUGEINT) & m AS z, m FROM {source}, mk),
b AS (SELECT i, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) & m AS z, m FROM a),
c AS (SELECT i, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) & m AS z FROM b),
h AS (SELECT i, xor(z, z >> 31) AS h FROM c)"""


_USERS = "(SELECT DISTINCT user_id AS i FROM events)"


@_query(_mixed_sql(_USERS) + " SELECT i AS id, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN CAST(h::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(h AS BIGINT) END AS h FROM h")
def splitmix64_hash(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return ids.select("id", splitmix64(F.col("id")).alias("h"))


@_query(_mixed_sql(_USERS) + f" SELECT i AS id, (h % {fx.SHARDS})::INT AS shard FROM h")
def shard_assignment(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return ids.select("id", shard_for(F.col("id"), fx.SHARDS).alias("shard"))


@_query(_mixed_sql("(SELECT vec_id AS i FROM embeddings)") + " SELECT (h % 7)::INT AS shard, count(*) AS n FROM h GROUP BY 1")
def shard_histogram(spark, sf_dir):
    return fx.corpus(spark, sf_dir).groupBy(shard_for(F.col("id"), 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT event_id, [CAST(event_id % 7 AS FLOAT), CAST(event_id % 11 AS FLOAT) / 4] = [CAST(event_id % 7 AS FLOAT), CAST(event_id % 11 AS FLOAT) / 4] AS same, CAST(event_id % 7 AS DOUBLE) AS v0, CAST(event_id % 11 AS DOUBLE) / 4 AS v1 FROM events")
def vector_literals(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    v = parse_vector(F.concat(F.lit(" "), (F.col("event_id") % 7).cast("string"), F.lit(" , "), ((F.col("event_id") % 11) / 4).cast("string")))
    return e.select("event_id", v.alias("v")).select("event_id", (F.size("v") == 2).alias("same"), F.get("v", F.lit(0)).cast("double").alias("v0"), F.get("v", F.lit(1)).cast("double").alias("v1"))


@_query(
    """
SELECT CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, user_id AS id,
       CASE WHEN event_type <> 'error' THEN CAST(event_id % 13 AS DOUBLE) END AS v0,
       CASE WHEN event_id % 10 = 0 THEN 'uncertain' ELSE 'confirmed' END AS standing
FROM events"""
)
def manifest_parse(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    tail = F.when(F.col("event_id") % 10 == 0, " uncertain").when(F.col("event_id") % 10 == 1, " confirmed # said so").otherwise("")
    put = F.concat(F.lit("put "), F.col("user_id").cast("string"), F.lit(" "), (F.col("event_id") % 13).cast("string"), F.lit(",1.5"), tail)
    gone = F.concat(F.lit("  del "), F.col("user_id").cast("string"), tail)
    lines = e.select(F.explode(F.array(F.lit("# a comment"), F.when(F.col("event_type") == "error", gone).otherwise(put))).alias("value"))
    return parse_manifest(lines).select("op", "id", F.get("vec", F.lit(0)).cast("double").alias("v0"), "standing")


@_query("SELECT CAST(64 AS INT) AS dim, CAST(1000 AS BIGINT) AS n, true AS centred, true AS unit_variance")
def gaussian_generator(spark, sf_dir):
    x = gaussian(spark, 1000, 64).select(F.size("vec").alias("dim"), F.explode("vec").alias("x"), "id")
    return x.groupBy("dim").agg(F.count_distinct("id").alias("n"), (F.abs(F.avg("x")) < 0.02).alias("centred"), (F.abs(F.stddev("x") - 1) < 0.02).alias("unit_variance"))


# --- logs ---------------------------------------------------------------------------------------

_LIVE = "SELECT id, lsn, CAST(len(vec) AS INT) AS dim, round(CAST(vec[1] AS DOUBLE), 6) AS v0 FROM live"


def _live(rows: DataFrame) -> DataFrame:
    return rows.select("id", "lsn", F.size("vec").alias("dim"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("v0"))


@_query(f"WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live('op_log')} {_LIVE}")
def log_replay_live(spark, sf_dir):
    return _live(log.replay(fx.op_log(spark, sf_dir)))


@_query(f"WITH {fx.SQL_EMB}, {fx.SQL_LOG}, prefix AS (SELECT * FROM op_log WHERE lsn <= {fx.SQL_MAX} // 2), {fx.sql_live('prefix')} {_LIVE}")
def log_replay_asof(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    return _live(log.replay(log.upto(ops, fx.half(ops))))


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}
SELECT count(*) FILTER (lsn > {fx.SQL_MAX} // 2) AS replayed, count(*) FILTER (lsn <= {fx.SQL_MAX} // 2) AS covered,
       max(lsn) AS max_lsn, count(*) FILTER (op = 'put') AS puts, count(*) FILTER (op = 'del') AS deletes
FROM op_log"""
)
def log_counts(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    return log.counts(ops, fx.half(ops))


@_query(f"WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live('op_log')} SELECT id, CAST(len(vec) AS INT) AS dim, round(CAST(vec[1] AS DOUBLE), 6) AS v0 FROM live")
def log_snapshot_plus_suffix(spark, sf_dir):
    """A snapshot is written and read back; with the log's suffix it gives the live state."""
    ops = fx.op_log(spark, sf_dir)
    mark, path = fx.half(ops), work_dir(spark)
    append_log(ops, f"{path}/log", fx.SHARDS)
    write_snapshot(log.replay(log.upto(ops, mark)), path, mark)
    snapshot, at = read_snapshot(spark, path)
    return _live(log.replay(read_log(spark, f"{path}/log"), snapshot, at)).drop("lsn")


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}
SELECT lsn, op, id FROM op_log WHERE lsn < {fx.SQL_MAX} * 3 // 4"""
)
def log_durable_prefix(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    torn = ops.agg(F.max("lsn")).first()[0] * 3 // 4
    records = ops.select(F.floor((F.col("lsn") - 1) / fx.SEGMENT).alias("seg"), ((F.col("lsn") - 1) % fx.SEGMENT).alias("off"), "lsn", "op", "id", (F.col("lsn") >= torn).alias("is_bad"))
    return log.durable_prefix(records).select("lsn", "op", "id")


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live('op_log')},
k AS (SELECT count(*) AS kept_records FROM op_log WHERE (lsn + {fx.SEGMENT - 1}) // {fx.SEGMENT} * {fx.SEGMENT} > {fx.SQL_MAX} // 2)
SELECT id, CAST(len(vec) AS INT) AS dim, round(CAST(vec[1] AS DOUBLE), 6) AS v0, kept_records FROM live, k"""
)
def log_compaction(spark, sf_dir):
    """A snapshot is written, the segments that it covers are deleted, and the state is recovered from what is left."""
    ops = fx.op_log(spark, sf_dir)
    mark, path = fx.half(ops), work_dir(spark)
    append_log(ops, f"{path}/log", segment=fx.SEGMENT)
    write_snapshot(log.replay(log.upto(read_log(spark, f"{path}/log"), mark)), path, mark)
    truncate_log(spark, f"{path}/log", mark)
    snapshot, at = read_snapshot(spark, path)
    left = read_log(spark, f"{path}/log")
    n = F.broadcast(left.agg(F.count(F.lit(1)).alias("kept_records")))  # one row
    return _live(log.replay(left, snapshot, at)).drop("lsn").join(n)


@_query(
    """
WITH m AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0)
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT id FROM m)"""
)
def member_messages(spark, sf_dir):
    members = fx.corpus(spark, sf_dir).select("id").where("id % 3 <> 0")
    return log.from_members(fx.table(spark, sf_dir, "events"), members, "user_id").select("event_id", "user_id")


@_query(f"WITH {fx.SQL_EMB}, {fx.SQL_LOG} SELECT max(lsn) AS max_lsn FROM op_log")
def log_max_lsn(spark, sf_dir):
    return fx.op_log(spark, sf_dir).agg(F.max("lsn").alias("max_lsn"))


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, s AS (SELECT (lsn - 1) // {fx.SEGMENT} AS seg, max(lsn) AS max_lsn FROM op_log GROUP BY 1)
SELECT seg, max_lsn FROM s WHERE max_lsn <= {fx.SQL_MAX} // 2 AND seg < (SELECT max(seg) FROM s)"""
)
def wal_segment_truncation(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    return log.truncatable_segments(ops.withColumn("seg", F.floor((F.col("lsn") - 1) / fx.SEGMENT)), fx.half(ops))


@_query(
    """
SELECT r.i AS replayed, s.i AS snapshotted, r.i >= 1000 OR (s.i > 0 AND r.i > 0.5 * s.i) AS due
FROM (SELECT unnest([0, 1, 500, 999, 1000, 1001, 5000])::BIGINT AS i) r, (SELECT unnest([0, 1, 100, 1000, 1998, 20000])::BIGINT AS i) s"""
)
def compaction_decision(spark, sf_dir):
    r = spark.createDataFrame([(x,) for x in (0, 1, 500, 999, 1000, 1001, 5000)], "replayed long")
    s = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 100, 1000, 1998, 20000)]))
    return r.withColumn("snapshotted", s).withColumn("due", log.should_compact(F.col("replayed"), F.col("snapshotted")))


_SUPER = f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG},
s AS (SELECT lsn AS pos, lsn - 7 * (lsn // 50) AS idx, lsn // 50 AS term, op, id FROM op_log),
w AS (SELECT *, min(idx) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, lag(idx) OVER (ORDER BY pos) AS prev FROM s)"""


@_query(f"{_SUPER} SELECT pos, idx, term, op, id FROM w WHERE later IS NULL OR later > idx")
def log_supersession(spark, sf_dir):
    return log.surviving(fx.super_log(fx.op_log(spark, sf_dir))).select("pos", "idx", "term", "op", "id")


@_query(f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, s AS (SELECT lsn AS pos, lsn + 2 * (lsn // 333) AS idx FROM op_log),
w AS (SELECT *, lag(idx) OVER (ORDER BY pos) AS prev FROM s) SELECT pos, idx FROM w WHERE idx > prev + 1""")
def log_index_gaps(spark, sf_dir):
    rows = fx.op_log(spark, sf_dir).select(F.col("lsn").alias("pos"), (F.col("lsn") + 2 * F.floor(F.col("lsn") / 333)).alias("idx"))
    return log.index_gaps(rows).select("pos", "idx")


@_query(f"{_SUPER} SELECT idx, term, op, id FROM w WHERE (later IS NULL OR later > idx) AND idx <= (SELECT max(idx) FROM s) // 2")
def committed_commands(spark, sf_dir):
    """Surviving records up to the commit index, here in the middle of the log."""
    records = fx.super_log(fx.op_log(spark, sf_dir))
    commit = records.agg(F.max("idx")).first()[0] // 2
    return log.surviving(records).where(F.col("idx") <= commit).select("idx", "term", "op", "id")


@_query(f"{_SUPER} SELECT idx, term, op, id FROM w WHERE pos <= (SELECT max(pos) FROM s) * 7 // 10 AND idx <= (SELECT max(idx) FROM s) * 6 // 10")
def persisted_commands(spark, sf_dir):
    """Records in the durable part of a log, up to the index a restored state has."""
    records = fx.super_log(fx.op_log(spark, sf_dir))
    pos, idx = records.agg(F.max("pos"), F.max("idx")).first()
    return records.where((F.col("pos") <= pos * 7 // 10) & (F.col("idx") <= idx * 6 // 10)).select("idx", "term", "op", "id")


@_query(
    """
WITH m AS (SELECT user_id % 50 AS group_id, event_id % 5 AS node, max(event_id) AS match FROM events GROUP BY ALL),
q AS (SELECT group_id, list_sort(list(match), 'DESC')[len(list(match)) // 2 + 1] AS idx FROM m GROUP BY group_id)
SELECT group_id, idx AS commit FROM q WHERE idx % 3 <> 0"""
)
def quorum_commit_index(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    matches = e.groupBy((F.col("user_id") % 50).alias("group_id"), (F.col("event_id") % 5).alias("node")).agg(F.max("event_id").alias("match"))
    terms = e.select(F.col("event_id").alias("idx"), F.when(F.col("event_id") % 3 != 0, 2).otherwise(1).alias("term"))
    return log.commit_index(matches, terms, 2)


_EXACT = "CASE WHEN x = 0 THEN CASE WHEN signbit(x) THEN '-0' ELSE '0' END " + " ".join(f"WHEN abs(x) < {below!r}::DOUBLE THEN '{n}:' || trunc(x * {scale!r}::DOUBLE)::BIGINT" for n, (below, scale) in enumerate(audit.BANDS)) + " END"

# --- audits -------------------------------------------------------------------------------------

_AUDIT = f"WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.SQL_MANIFEST}"


def _sides(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    return ops, fx.manifest_of(ops)


@_query(f"{_AUDIT} SELECT DISTINCT id FROM op_log WHERE id NOT IN (SELECT id FROM manifest)")
def audit_phantom(spark, sf_dir):
    return audit.phantoms(*_sides(spark, sf_dir))


@_query(f"{_AUDIT} SELECT DISTINCT id FROM manifest WHERE standing = 'confirmed' AND id NOT IN (SELECT id FROM op_log)")
def audit_missing(spark, sf_dir):
    return audit.missing(*_sides(spark, sf_dir))


@_query(
    f"""{_AUDIT}, {fx.sql_live("op_log", "a")}, {fx.sql_live("manifest", "b")}, u AS (SELECT id FROM manifest WHERE standing = 'uncertain')
SELECT id, CASE WHEN b.vec IS NULL THEN 'only in log' WHEN a.vec IS NULL THEN 'only in manifest' ELSE 'other vector' END AS why
FROM a FULL JOIN b USING (id) WHERE a.vec IS DISTINCT FROM b.vec AND id NOT IN (SELECT id FROM u)"""
)
def audit_value_mismatch(spark, sf_dir):
    return audit.mismatches(*_sides(spark, sf_dir))


@_query(
    f"""{_AUDIT}, u AS (SELECT DISTINCT id, id IN (SELECT id FROM op_log) AS seen FROM manifest WHERE standing = 'uncertain')
SELECT count(*) FILTER (seen) AS present, count(*) FILTER (NOT seen) AS absent FROM u"""
)
def audit_uncertain(spark, sf_dir):
    return audit.uncertain_tally(*_sides(spark, sf_dir))


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, t AS (SELECT {fx.SQL_MAX} // 2 AS top),
a AS (SELECT row_number() OVER (ORDER BY lsn) AS n, op, id, vec FROM op_log),
b AS (SELECT row_number() OVER (ORDER BY lsn) AS n, op, CASE WHEN lsn = top + 3 THEN id + 1 ELSE id END AS id, vec FROM op_log, t WHERE lsn <= top * 2 - top // 5)
SELECT count(a.n) AS n_a, count(b.n) AS n_b, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS shared,
       min(a.n) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL AND (a.op, a.id) <> (b.op, b.id)) AS first_diff
FROM a FULL JOIN b ON a.n = b.n"""
)
def compare_logs_first_diff(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    return audit.first_disagreement(ops, fx.replica(ops))


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, t AS (SELECT {fx.SQL_MAX} // 2 AS top),
a AS (SELECT row_number() OVER (ORDER BY lsn) AS n, op, id, vec FROM op_log),
o AS (SELECT 1 AS replica, lsn, op, id, vec FROM op_log UNION ALL
      SELECT 2, lsn, op, CASE WHEN lsn = top + 3 THEN id + 1 ELSE id END, vec FROM op_log, t WHERE lsn <= top * 2 - top // 5 UNION ALL
      SELECT 3, lsn, op, id, CASE WHEN lsn > top THEN list_reverse(vec) ELSE vec END FROM op_log, t),
b AS (SELECT replica, row_number() OVER (PARTITION BY replica ORDER BY lsn) AS n, op, id, vec FROM o)
SELECT CAST(replica AS INT) AS replica, (SELECT count(*) FROM a) AS n_a, count(b.n) AS n_b, count(a.n) AS shared,
       min(b.n) FILTER (a.n IS NOT NULL AND (a.op <> b.op OR a.id <> b.id OR a.vec IS DISTINCT FROM b.vec)) AS first_diff
FROM b LEFT JOIN a ON a.n = b.n GROUP BY replica"""
)
def compare_replicas(spark, sf_dir):
    """Replicas against replica 0: an equal one, a shorter one with another id, one with other vectors."""
    ops = fx.op_log(spark, sf_dir)
    turned = F.when(F.col("lsn") > fx.half(ops), F.reverse("vec")).otherwise(F.col("vec"))
    return audit.disagreements(ops, {1: ops, 2: fx.replica(ops), 3: ops.withColumn("vec", turned)})


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG},
l AS (SELECT arg_max(id, lsn) AS last, max(lsn) AS m, max(id) AS top, max(lsn) FILTER (op = 'put') AS p FROM op_log),
c AS (SELECT coalesce(max(lsn), 0) AS cut FROM op_log, l WHERE id <> last),
g AS (SELECT 'none' AS fault, lsn, op, id, vec FROM op_log UNION ALL
      SELECT 'phantom', lsn, op, id, vec FROM op_log UNION ALL
      SELECT 'phantom', m + 1, 'put', top + 1, vec FROM op_log, l WHERE lsn = p UNION ALL
      SELECT 'missing', lsn, op, id, vec FROM op_log, c WHERE lsn <= cut UNION ALL
      SELECT 'repeat', lsn, op, id, vec FROM op_log UNION ALL
      SELECT 'repeat', m + 1, 'put', id, vec FROM op_log, l WHERE lsn = p),
s AS (SELECT fault, id, arg_max(op, lsn) AS op, max(lsn) AS lsn FROM g GROUP BY fault, id),
b AS (SELECT f.fault, id, op, lsn FROM s, (SELECT DISTINCT fault FROM g) f WHERE s.fault = 'none'),
v AS (SELECT s.fault, s.id, s.op, g.vec FROM s JOIN g USING (fault, id, lsn)),
w AS (SELECT b.fault, b.id, b.op, o.vec FROM b JOIN op_log o USING (id, lsn)),
x AS (SELECT fault, id, 'phantom' AS finding FROM s WHERE id NOT IN (SELECT id FROM op_log) UNION ALL
      SELECT fault, id, 'missing' FROM b WHERE NOT EXISTS (FROM s WHERE s.fault = b.fault AND s.id = b.id) UNION ALL
      SELECT fault, id, 'mismatch' FROM (SELECT * FROM v WHERE op = 'put') v FULL JOIN (SELECT * FROM w WHERE op = 'put') w USING (fault, id) WHERE v.vec IS DISTINCT FROM w.vec)
SELECT fault, finding, id FROM x UNION ALL SELECT 'corrupt', 'corrupt segment', 0 WHERE {fx.SQL_MAX} > {fx.SEGMENT}"""
)
def audit_faults(spark, sf_dir):
    """What the audits find in a log after each fault, and nothing in the log as it is."""
    ops = fx.op_log(spark, sf_dir)
    emitted = ops.withColumn("standing", F.lit("confirmed"))
    logs = {"none": ops, "phantom": audit.with_phantom(ops, emitted), "missing": audit.with_missing(ops), "repeat": audit.with_repeat(ops)}
    at = F.col("lsn") - 1
    records = ops.select(F.floor(at / fx.SEGMENT).alias("seg"), (at % fx.SEGMENT).alias("off"), F.lit(False).alias("is_bad"))
    out = log.corrupt_segments(audit.with_corruption(records)).select(F.lit("corrupt").alias("fault"), F.lit("corrupt segment").alias("finding"), F.col("seg").alias("id"))
    for fault, rows in logs.items():
        out = out.unionByName(audit.findings(rows, emitted).select(F.lit(fault).alias("fault"), "finding", "id"))
    return out


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live("op_log")},
i AS (SELECT id FROM live WHERE id % 10 <> 0 UNION ALL SELECT id + 2000000 FROM live WHERE id % 50 = 1)
SELECT id, 'extra' AS side FROM i WHERE id NOT IN (SELECT id FROM live) UNION ALL
SELECT id, 'missing' FROM live WHERE id NOT IN (SELECT id FROM i)"""
)
def index_set_diff(spark, sf_dir):
    live = log.replay(fx.op_log(spark, sf_dir)).select("id")
    index = live.where("id % 10 <> 0").union(live.where("id % 50 = 1").select(F.col("id") + 2_000_000))
    return audit.set_difference(index, live)


@_query(
    f"""
WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live("op_log")},
r AS (SELECT sha256(id || '|' || len(vec) || '|' || array_to_string(list_transform(CAST(vec AS DOUBLE[]), lambda x: {_EXACT}), ',')) AS d FROM live),
s AS (SELECT count(*) AS n, {", ".join(f"sum(('0x' || substr(d, {1 + 8 * k}, 8))::BIGINT)::VARCHAR AS s{k}" for k in range(8))} FROM r)
SELECT n, sha256(concat_ws(',', {", ".join(f"s{k}" for k in range(8))})) AS digest FROM s"""
)
def state_digest(spark, sf_dir):
    """The digest of a stored log, read as an audit reads it."""
    path = work_dir(spark)
    append_log(fx.op_log(spark, sf_dir), f"{path}/log")
    return audit.state_digest(log.replay(uncompacted_log(spark, path)))


@_query(f"WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live('op_log')} SELECT count(*) AS n, true AS equal FROM live")
def store_count(spark, sf_dir):
    ops = fx.op_log(spark, sf_dir)
    last = ops.groupBy("id").agg(F.max_by("op", "lsn").alias("op")).where("op = 'put'").agg(F.count(F.lit(1)).alias("m"))
    live = log.replay(ops).agg(F.count(F.lit(1)).alias("n"))
    return live.join(F.broadcast(last)).select("n", (F.col("n") == F.col("m")).alias("equal"))


@_query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    p = lambda x: F.round(F.percentile("value", x), 6)
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


# --- streams ------------------------------------------------------------------------------------


@_query(f"WITH {fx.SQL_EMB}, {fx.SQL_LOG}, {fx.sql_live('op_log')} {_LIVE}")
def stream_apply_live(spark, sf_dir):
    """The log as files, applied by a stream; batches keep last writes only."""
    path = work_dir(spark)
    append_log(fx.op_log(spark, sf_dir).repartition(4, "id"), f"{path}/log")
    apply.start_apply(apply.log_stream(spark, f"{path}/log", 1), f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return _live(apply.live(spark, f"{path}/state"))


@_query(
    """
WITH b AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS w FROM events),
g AS (SELECT user_id, w, lag(w) OVER (PARTITION BY user_id ORDER BY w) AS before FROM b)
SELECT user_id, before + 1 AS first_missed, w - before - 1 AS n_missed FROM g WHERE w - before - 1 >= 2"""
)
def service_health_windows(spark, sf_dir):
    return apply.missed_windows(fx.table(spark, sf_dir, "events"), 3600)


@_query(
    """
WITH b AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS w FROM events),
g AS (SELECT user_id, w, lead(w) OVER (PARTITION BY user_id ORDER BY w) AS next FROM b)
SELECT user_id, w + 1 AS first_missed FROM g WHERE coalesce(next - w - 1 >= 2, true) AND w + 3 <= (SELECT max(w) FROM b)"""
)
def stream_health_sessions(spark, sf_dir):
    """Users that fall silent for two hours, as a stream tells them: up to its watermark."""
    path = work_dir(spark)
    events = fx.table(spark, sf_dir, "events").select("user_id", "ts")
    events.write.parquet(f"{path}/beats")
    told = apply.unhealthy_since(spark.readStream.schema(events.schema).parquet(f"{path}/beats"), 3600)
    told.writeStream.format("parquet").outputMode("append").option("path", f"{path}/told").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}/told")


@_query("SELECT event_id, user_id FROM events")
def stream_requests_once(spark, sf_dir):
    """Every request is delivered twice and applied once."""
    path = work_dir(spark)
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.union(events).repartition(4).write.parquet(f"{path}/requests")
    kept = apply.once(spark.readStream.schema(events.schema).parquet(f"{path}/requests"), "event_id", "ts", "1 hour").select("event_id", "user_id")
    kept.writeStream.format("parquet").outputMode("append").option("path", f"{path}/kept").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{path}/kept")
