import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.operators import audit, hnsw, log
from quillon.plans.engine import Engine
from quillon.schema import LOG, EngineError
from quillon.sources import files
from quillon.streaming import apply

ROWS = [(1, "put", 1, [1.0]), (2, "put", 2, [2.0]), (3, "del", 1, None), (4, "put", 3, [3.0]), (5, "put", 3, [4.0])]


def found(committed, emitted):
    return sorted((r.finding, r.id) for r in audit.findings(committed, emitted).collect())


def test_each_fault_is_found(spark):
    committed = spark.createDataFrame(ROWS, LOG)
    emitted = committed.withColumn("standing", F.lit("confirmed"))
    assert found(committed, emitted) == []
    assert found(audit.with_phantom(committed, emitted), emitted) == [("mismatch", 4), ("phantom", 4)]
    assert found(audit.with_missing(committed), emitted) == [("mismatch", 3), ("missing", 3)]
    assert found(audit.with_repeat(committed), emitted) == []
    empty = committed.limit(0)
    for rows in (audit.with_phantom(empty, emitted.limit(0)), audit.with_missing(empty), audit.with_repeat(empty)):
        assert rows.count() == 0


def test_damage_before_the_last_segment(spark):
    records = spark.createDataFrame([(s, o, False) for s in range(3) for o in range(2)], "seg long, off long, is_bad boolean")
    assert [r.seg for r in log.corrupt_segments(audit.with_corruption(records)).collect()] == [0]
    assert log.corrupt_segments(audit.with_corruption(records.where("seg = 2"))).count() == 0  # a torn tail
    assert log.corrupt_segments(records).count() == 0


def test_members(spark):
    messages = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c"), (None, "d")], "sender long, m string")
    members = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert sorted(r.m for r in log.from_members(messages, members).collect()) == ["a", "c"]


def test_replicas(spark):
    base = spark.createDataFrame(ROWS, LOG)
    other = base.withColumn("id", F.when(F.col("lsn") == 4, 7).otherwise(F.col("id")))
    got = {r.replica: (r.n_b, r.shared, r.first_diff) for r in audit.disagreements(base, {1: base, 2: base.where("lsn < 3"), 3: other}).collect()}
    assert got == {1: (5, 5, None), 2: (2, 2, None), 3: (5, 5, 4)}


def test_exact_text_tells_all_floats_apart(spark):
    r = np.random.default_rng(1)
    bits = np.concatenate([r.integers(0, 2**32, 20000, np.uint64).astype(np.uint32), np.arange(64, dtype=np.uint32), np.array([0x80000000, 0x7F7FFFFF, 0x00800000, 0x007FFFFF], np.uint32)])
    x = np.unique(bits).view(np.float32)
    x = x[np.isfinite(x)]
    rows = spark.createDataFrame([([float(v) for v in x],)], "v array<float>")
    text = rows.select(F.transform("v", audit.exact_text)).first()[0]
    assert None not in text and len(set(text)) == len(x)


def test_truncation_keeps_what_no_snapshot_covers(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "put", r.randrange(20), [float(i)]) for i in range(1, 101)]
    path = str(tmp_path)
    files.append_log(spark.createDataFrame(rows, LOG), f"{path}/log", segment=10)
    before = {x.id: x.vec for x in log.replay(files.read_log(spark, f"{path}/log")).collect()}
    files.write_snapshot(log.replay(log.upto(files.read_log(spark, f"{path}/log"), 55)), path, 55)
    assert files.truncate_log(spark, f"{path}/log", 55) == 5
    assert files.truncate_log(spark, f"{path}/log", 55) == 0
    left = files.read_log(spark, f"{path}/log")
    assert left.count() == 50
    snapshot, mark = files.read_snapshot(spark, path)
    assert {x.id: x.vec for x in log.replay(left, snapshot, mark).collect()} == before
    assert files.truncate_log(spark, f"{path}/log", 100) == 5
    assert files.read_log(spark, f"{path}/log").count() == 0
    assert files.truncate_log(spark, f"{path}/none", 1) == 0


def test_audits_refuse_missing_and_compacted_logs(spark, tmp_path):
    with pytest.raises(EngineError, match="no such folder"):
        files.uncompacted_log(spark, str(tmp_path / "typo"))
    c = Engine(spark).create_collection("a", 1, path=str(tmp_path / "a"))
    c.upsert([(1, [1.0])])
    assert files.uncompacted_log(spark, c.path).count() == 1
    c.checkpoint()
    with pytest.raises(EngineError, match="compacted"):
        files.uncompacted_log(spark, c.path)


def test_opening_compacts_a_long_log(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Engine(spark).create_collection("c", 1, "l2", path=path)
    for i in range(3):
        c.upsert([(i, [float(i)])])
    assert c.checkpoint() == 3 and c.log().count() == 0
    c.upsert([(1, [7.0]), (5, [5.0])])
    again = Engine(spark).open_collection("c", 1, "l2", path=path)
    assert again.log().count() == 0 and again.count() == 4 and again.get(1) == [7.0]
    assert again.upsert([(6, [6.0])]) == 5
    assert Engine(spark).open_collection("c", 1, "l2", path=path).log().count() == 1  # too short to compact
    with pytest.raises(EngineError):
        Engine(spark).open_collection("x", 1)


def test_a_stored_graph_serves_until_the_next_write(spark, tmp_path):
    p = hnsw.Params(m=4, ef_construction=20, ef_search=20)
    c = Engine(spark).create_collection("g", 2, "l2", path=str(tmp_path / "g"))
    c.upsert([(i, [float(i), 0.0]) for i in range(30)])
    where = c.build_index(2, p)
    assert c.build_index(2, p) == where and files.has_graph(spark, where)
    q = spark.createDataFrame([(0, [0.0, 0.0])], "q_id long, q array<float>")
    assert [r.id for r in c.query_batch(q, 3, "hnsw", 2, p).orderBy("rank").collect()] == [0, 1, 2]
    c.delete([1])
    assert not files.has_graph(spark, c._index_path(2, p))
    assert [r.id for r in c.query_batch(q, 3, "hnsw", 2, p).orderBy("rank").collect()] == [0, 2, 3]


def test_deleting_repairs_neighbourhoods(spark):
    r = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(300)], "id long, vec array<float>")
    p = hnsw.Params(m=6, ef_construction=50, ef_search=80)
    graph = hnsw.build(corpus, 2, "l2", p).cache()
    gone = spark.createDataFrame([(i,) for i in [*range(0, 300, 3), 100, 999]], "id long")
    after = hnsw.delete(graph, gone, 2, "l2", p).cache()
    live = corpus.where("id % 3 <> 0 AND id <> 100")
    assert audit.set_difference(after, live).count() == 0
    assert hnsw.asymmetric_edges(after).count() == 0
    assert hnsw.edges(after).join(live.select(F.col("id").alias("b")), "b", "left_anti").count() == 0
    for row in after.collect():
        assert all(len(x) <= p.cap(n) and len(set(x)) == len(x) for n, x in enumerate(row.neighbors))
    from quillon.operators import knn

    q = live.where("id % 10 = 1").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    assert knn.recall(hnsw.search(after, q, 10, "l2", p), knn.knn(live, q, 10, "l2")).first()["recall"] >= 0.95
    one = spark.createDataFrame([(7,)], "id long")
    assert hnsw.delete(graph, one, 2, "l2", p).count() == 299
    assert hnsw.delete(graph, one.limit(0), 2, "l2", p).count() == 300
    assert hnsw.delete(graph, corpus.select("id"), 2, "l2", p).count() == 0


def beats(spark, hours):
    return spark.createDataFrame([(u, h * 3600 + 5) for u, h in hours], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))


def test_silence_is_told_after_two_windows(spark, tmp_path):
    # 1: two hours are missed after hour 0; 2: one hour only; 3: beats in other order and twice
    hours = [(1, 0), (1, 3), (2, 0), (2, 2), (2, 3), (3, 3), (3, 0), (3, 0), (3, 1)]
    got = apply.unhealthy_since(beats(spark, hours), 3600).collect()
    assert sorted((r.user_id, r.first_missed) for r in got) == [(1, 1), (1, 4), (2, 4), (3, 4)]
    rows = beats(spark, hours)
    path = str(tmp_path / "beats")
    rows.coalesce(1).write.mode("append").parquet(path)
    beats(spark, [(9, 6)]).coalesce(1).write.mode("append").parquet(path)  # moves the watermark
    told = apply.unhealthy_since(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), 3600)
    told.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user_id, r.first_missed) for r in spark.table("told").collect()) == [(1, 1), (1, 4), (2, 4), (3, 4)]


def test_command_line(spark, tmp_path):
    path, lines = str(tmp_path / "cli"), []

    def run(*args, typed=()):
        lines.clear()
        return main(["--path", path, *args], spark, typed, lines.append), list(lines)

    assert run("--op", "search", "--vec", "0,0,0") == (0, ["ok neighbors=0"])
    assert run("--op", "put", "--id", "4", "--vec", "1,0,0") == (0, ["ok index=1"])
    assert run("--op", "put", "--id", "5", "--vec", "1,0") == (1, ["error: vector has dim 2, collection has 3"])
    assert run("--op", "fly")[0] == 1
    session = ["put 7 0,2.5,0", "", "search 0,0,0 5", "del 4", "search 0,0,0 1", "put 1", "jump", "search 0,x,0 1", "exit", "put 9 1,1,1"]
    assert run(typed=session) == (0, ["ok index=2", "id=4 dist=1", "id=7 dist=2.5", "ok index=3", "id=7 dist=2.5", "usage: put <id> <f,f,f>", "unknown command 'jump'; type help", "bad vector '0,x,0': could not convert string to float: 'x'"])
