import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, log
from quillon.plans.engine import Engine
from quillon.schema import LOG, Duplicate, EngineError, NotFound
from quillon.sources import files
from quillon.streaming import apply


def random_log(seed, n=120, ids=15):
    r = random.Random(seed)
    return [(i + 1, "del", r.randrange(ids), None) if r.random() < 0.33 else (i + 1, "put", r.randrange(ids), [float(i), r.random()]) for i in range(n)]


def model(rows):
    live = {}
    for _, op, i, v in rows:
        if op == "put":
            live[i] = v
        else:
            live.pop(i, None)
    return live


def state(df):
    return {r.id: [pytest.approx(x) for x in r.vec] for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_replay_is_the_model_in_any_order(spark, seed):
    rows = random_log(seed)
    shuffled = rows + rows[::3]
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, LOG)
    assert state(log.replay(df)) == model(rows)
    for cut in (0, 1, 40, 119):
        assert state(log.replay(log.upto(df, cut))) == model(rows[:cut])
        snapshot = log.replay(log.upto(df, cut)).select("id", "vec")
        assert state(log.replay(df, snapshot, cut)) == model(rows)


def test_durable_prefix_at_every_record(spark):
    rows = [(i // 5, i % 5, i) for i in range(12)]
    for torn in (0, 4, 5, 11, 99):
        df = spark.createDataFrame([(s, o, n, n == torn or n == torn + 2) for s, o, n in rows], "seg long, off long, n int, is_bad boolean")
        assert sorted(r.n for r in log.durable_prefix(df).collect()) == list(range(min(torn, 12)))


def test_supersession_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(log, "BLOCK", 7)
    r = random.Random(1)
    idx, rows = 0, []
    for pos in range(100):
        idx = max(1, idx - r.randrange(6)) if r.random() < 0.2 else idx + 1
        rows.append((pos, idx))
    alive = {}
    for pos, i in rows:
        alive = {k: v for k, v in alive.items() if k < i}
        alive[i] = pos
    df = spark.createDataFrame(rows, "pos long, idx long")
    assert sorted(x.pos for x in log.surviving(df).collect()) == sorted(alive.values())
    assert log.index_gaps(df).count() == 0
    assert [x.pos for x in log.index_gaps(spark.createDataFrame([(0, 1), (1, 2), (9, 5)], "pos long, idx long")).collect()] == [9]


def test_ordinals(spark, monkeypatch):
    monkeypatch.setattr(log, "BLOCK", 4)
    df = spark.createDataFrame([(x,) for x in (9, 2, 40, 7, 3)], "lsn long")
    assert {r.lsn: r.ordinal for r in log.with_ordinal(df, "lsn").collect()} == {2: 1, 3: 2, 7: 3, 9: 4, 40: 5}


def test_quorum(spark):
    m = spark.createDataFrame([(1, n, x) for n, x in enumerate((9, 4, 7))] + [(2, n, x) for n, x in enumerate((1, 2, 3, 8, 9))], "group_id int, node int, match long")
    t = spark.createDataFrame([(7, 2), (3, 1)], "idx long, term int")
    assert [tuple(r) for r in log.commit_index(m, t, 2).collect()] == [(1, 7)]
    assert [log.quorum(n) for n in (1, 2, 3, 5)] == [1, 2, 2, 3]


def test_audits_red_and_green(spark):
    rows = random_log(7)
    committed = spark.createDataFrame(rows, LOG)
    emitted = committed.withColumn("standing", F.lit("confirmed"))
    assert audit.phantoms(committed, emitted).count() == audit.missing(committed, emitted).count() == audit.mismatches(committed, emitted).count() == 0
    assert audit.mismatches(committed.union(committed), emitted).count() == 0  # duplicates are harmless
    ids = {r[2] for r in rows}
    live = model(rows)
    one = next(iter(live))
    assert {r.id for r in audit.phantoms(committed, emitted.where(F.col("id") != one)).collect()} == {one}
    assert {r.id for r in audit.missing(committed.where(F.col("id") != one), emitted).collect()} == {one}
    changed = committed.withColumn("vec", F.when(F.col("id") == one, F.transform("vec", lambda x: (x + 1).cast("float"))).otherwise(F.col("vec")))
    assert [(r.id, r.why) for r in audit.mismatches(changed, emitted).collect()] == [(one, "other vector")]
    doubt = emitted.withColumn("standing", F.when(F.col("id") == one, "uncertain").otherwise(F.col("standing")))
    assert audit.mismatches(changed, doubt).count() == 0
    assert tuple(audit.uncertain_tally(committed, doubt).first()) == (1, 0)
    assert len(ids) >= len(live)
    shorter = committed.where("lsn <= 100").withColumn("id", F.when(F.col("lsn") == 42, -1).otherwise(F.col("id")))
    assert tuple(audit.first_disagreement(committed, shorter).first()) == (120, 100, 100, 42)
    assert audit.first_disagreement(committed, committed).first()["first_diff"] is None


def test_digest(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "id long, vec array<float>")
    b = spark.createDataFrame([(2, [3.0]), (1, [1.0, 2.0])], "id long, vec array<float>").repartition(3)
    c = spark.createDataFrame([(2, [3.0]), (1, [1.0, 2.5])], "id long, vec array<float>")
    d = [audit.state_digest(x).first()["digest"] for x in (a, b, c, a.limit(0))]
    assert d[0] == d[1] and len(set(d)) == 3


def test_engine_and_collection(spark, tmp_path):
    e = Engine(spark)
    c = e.create_collection("a", 2, "l2")
    with pytest.raises(Duplicate):
        e.create_collection("a", 2)
    with pytest.raises(NotFound):
        e.collection("b")
    with pytest.raises(EngineError):
        e.create_collection("b", 0)
    assert c.query([0.0, 0.0], 3).count() == 0
    first = c.upsert([(1, [1, 0]), (2, [5, 0]), (3, [10, 0])])
    c.upsert([(2, [0.5, 0])])
    assert [r.id for r in c.query([0.0, 0.0], 2).collect()] == [2, 1]
    assert [r.id for r in c.query([0.0, 0.0], 2, as_of=first).collect()] == [1, 2]
    with pytest.raises(NotFound):
        c.delete([77])
    c.delete([77], missing="ignore")
    c.delete([2])
    assert [r.id for r in c.ids().collect()] == [1, 3] and c.count() == 2
    assert c.get(3) == [10.0, 0.0]
    with pytest.raises(NotFound):
        c.get(2)
    with pytest.raises(EngineError):
        c.query([1.0], 1)
    with pytest.raises(Exception, match="invalid vector"):
        c.upsert([(4, [1, 2, 3])])
    q = spark.createDataFrame([(0, [0.0, 0.0])], "q_id long, q array<float>")
    want = [(0, 1, 1), (0, 2, 3)]
    for method in ("exact", "sharded", "hnsw"):
        assert [(r.q_id, r["rank"], r.id) for r in c.query_batch(q, 5, method).orderBy("rank").collect()] == want


def test_durable_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Engine(spark).create_collection("d", 2, path=path)
    c.upsert([(1, [1, 0]), (2, [2, 0])])
    assert c.checkpoint() == 1
    c.upsert([(2, [3, 0]), (3, [4, 0])])
    c.delete([1])
    again = Engine(spark).create_collection("d", 2, path=path)
    assert {r.id: list(r.vec) for r in again.vectors().collect()} == {2: [3.0, 0.0], 3: [4.0, 0.0]}
    assert again.maybe_checkpoint(factor=0.5) is True
    assert again.maybe_checkpoint(factor=0.5) is False
    assert again.count() == 2
    with pytest.raises(EngineError):
        again.vectors(as_of=1)


def test_snapshot_and_graph_files(spark, tmp_path):
    assert files.read_snapshot(spark, str(tmp_path)) == (None, 0)
    g = spark.createDataFrame([(0, 1, 0, [[2]], 1.0, [1.0])], "shard int, id long, level int, neighbors array<array<long>>, norm float, vec array<float>")
    files.write_graph(g, str(tmp_path / "g"), {"m": 8})
    back, meta = files.read_graph(spark, str(tmp_path / "g"))
    assert meta == {"m": 8} and back.first()["neighbors"] == [[2]]


def test_manifest_lines(spark):
    lines = spark.createDataFrame([("put 1 1,2 confirmed",), ("# no",), ("",), ("del 4 uncertain",), ("put 2 0.5",)], "value string")
    assert [(r.op, r.id, r.vec, r.standing) for r in files.parse_manifest(lines).collect()] == [("put", 1, [1.0, 2.0], "confirmed"), ("del", 4, None, "uncertain"), ("put", 2, [0.5], "confirmed")]
    for bad in ("put x 1", "put 1", "drop 1", "put 1 1,,2", "del 1 maybe"):
        df = spark.createDataFrame([(bad,)], "value string")
        with pytest.raises(Exception, match="malformed"):
            files.parse_manifest(df).collect()
        assert files.parse_manifest(df, strict=False).first()["op"] is None


def test_vector_files(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    raw = b"".join(np.int32(3).tobytes() + row.tobytes() for row in m)
    (tmp_path / "a.fvecs").write_bytes(raw)
    got = files.read_vecs(spark, str(tmp_path / "a.fvecs"), rows_per_task=3).orderBy("id").collect()
    assert [r.vec for r in got] == m.tolist()
    (tmp_path / "b.fvecs").write_bytes(raw[:-1])
    with pytest.raises(EngineError):
        files.read_vecs(spark, str(tmp_path / "b.fvecs"))
    assert files.gaussian(spark, 10, 4, 5).collect() == files.gaussian(spark, 10, 4, 5).repartition(3).orderBy("id").collect()


def test_stream_applies_late_and_repeated_writes(spark, tmp_path):
    rows = random_log(3, 60, 8)
    random.Random(9).shuffle(rows)
    for part in (rows[:30], rows[20:], rows[:5]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    apply.start_apply(apply.log_stream(spark, str(tmp_path / "log"), 1), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert state(apply.live(spark, str(tmp_path / "state"))) == model(sorted(rows, key=lambda r: r[0]))


def test_stateful_stream(spark, tmp_path):
    rows = random_log(5, 40, 6)
    for part in (rows[20:], rows[:20]):  # the older half comes late
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    q = apply.latest_writes(apply.log_stream(spark, str(tmp_path / "log"), 1)).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("latest").collect():
        assert r.id not in got or r.lsn > got[r.id]
        got[r.id] = r.lsn
    want = {}
    for lsn, _, i, _ in rows:
        want[i] = max(lsn, want.get(i, 0))
    assert got == want
