import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import distance, hashing
from quillon.functions.vectors import parse_vector
from quillon.operators import audit, hnsw, knn, lsh
from quillon.schema import EngineError, checked, defect, is_valid, split_valid

INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vec array<float>")


def random_corpus(spark, n=300, dim=8, seed=3):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, dim)).astype(np.float32)
    return m, vectors(spark, [(i, row.tolist()) for i, row in enumerate(m)]).repartition(5)


@pytest.mark.parametrize(
    "metric,a,b,want",
    [("dot", [1, 2, 3], [4, 5, 6], 32), ("l2", [0, 0], [3, 4], 5), ("cosine", [1, 2], [1, 2], 0), ("cosine", [1, 0], [0, 1], 1), ("cosine", [0, 0], [3, 4], 1)],
)
def test_metric_values(spark, metric, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(distance.METRICS[metric](F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-6)
    got = distance.distances(np.array([a], np.float32), np.array([b], np.float32), metric)
    assert got[0, 0] == pytest.approx(want, abs=1e-6)
    cached = df.select(distance.cosine_distance_cached(F.col("a"), F.col("b"), distance.norm(F.col("a")), distance.norm(F.col("b")))).first()[0]
    if metric == "cosine":
        assert cached == pytest.approx(want, abs=1e-6)


def test_validity(spark):
    rows = [("ok", [1.0, 2.0]), ("one", [1.0]), ("empty", []), ("null", None), ("nan", [NAN, 1.0]), ("inf", [1.0, INF]), ("ninf", [1.0, -INF])]
    df = spark.createDataFrame(rows, "name string, vec array<float>").withColumn("id", F.lit(1))
    got = {r.name: (r.ok, r.why) for r in df.select("name", is_valid(F.col("vec")).alias("ok"), defect(F.col("vec"), 2).alias("why")).collect()}
    assert got == {"ok": (True, None), "one": (True, "dimension"), "empty": (False, "empty"), "null": (False, "empty"), "nan": (False, "non-finite"), "inf": (False, "non-finite"), "ninf": (False, "non-finite")}
    good, bad = split_valid(df, 2)
    assert (good.count(), bad.count()) == (1, 6)
    with pytest.raises(Exception, match="invalid vector"):
        checked(df, 2).collect()


def test_mixer_known_answers(spark):
    known = {0: 0xE220A8397B1DCDAF, 1: 0x910A2DEC89025CC1, 2: 0x975835DE1C9756CE, 42: 0xBDD732262FEB6E95, 2**64 - 1: 0xE4D971771B652C20}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(k), signed(v)) for k, v in known.items()], "x long, want long")
    assert df.where(hashing.splitmix64(F.col("x")) != F.col("want")).count() == 0
    assert all(hashing.splitmix64_int(k) == v for k, v in known.items())
    ids = spark.range(-500, 1500)
    for shards in (1, 3, 7):
        for r in ids.select("id", hashing.shard_for(F.col("id"), shards).alias("s")).collect():
            assert r.s == hashing.splitmix64_int(r.id & (2**64 - 1)) % shards


def test_search_small_cases(spark):
    axes = vectors(spark, [(1, [1, 0, 0]), (2, [0, 1, 0]), (3, [0, 0, 1])])
    assert knn.nearest(axes, [1.0, 0.0, 0.0], 1).first()["id"] == 1
    line = vectors(spark, [(1, [1, 0]), (2, [5, 0]), (3, [10, 0])])
    assert [r.id for r in knn.nearest(line, [0.0, 0.0], 2, "l2").collect()] == [1, 2]
    assert knn.nearest(line, [0.0, 0.0], 50, "l2").count() == 3
    assert knn.nearest(line.limit(0), [0.0, 0.0], 5, "l2").count() == 0
    for bad in (lambda: knn.nearest(line, [0.0, 0.0], 0), lambda: knn.nearest(line, [NAN, 0.0], 1), lambda: knn.nearest(line, [], 1)):
        with pytest.raises(EngineError):
            bad()
    ties = vectors(spark, [(9, [1, 0]), (4, [1, 0]), (7, [1, 0])])
    assert [r.id for r in knn.nearest(ties, [1.0, 0.0], 2, "l2").collect()] == [4, 7]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_batch_search_ways_agree(spark, metric):
    m, corpus = random_corpus(spark)
    q = corpus.where("id < 7").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    rows = lambda df: sorted((r.q_id, r["rank"], r.id, r.distance) for r in df.collect())
    exact = rows(knn.knn(corpus, q, 5, metric))
    d = distance.distances(m[:7], m, metric)
    brute = [(i, n + 1, int(j), float(d[i, j])) for i in range(7) for n, j in enumerate(np.lexsort((np.arange(len(m)), d[i]))[:5])]
    assert exact == brute
    assert rows(knn.knn_by_expression(corpus, q, 5, metric)) == brute
    for shards in (1, 2, 3, 7):
        assert rows(knn.knn_sharded(corpus, q, 5, metric, shards)) == brute


def test_own_metric_and_blocks(spark, monkeypatch):
    _, corpus = random_corpus(spark, 40)
    q = corpus.where("id < 9").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    whole = sorted(map(tuple, knn.knn(corpus, q, 3, "l2").collect()))
    monkeypatch.setattr(knn, "QUERY_BYTES", 100)
    assert sorted(map(tuple, knn.knn(corpus, q, 3, "l2").collect())) == whole
    first = lambda a, b: F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))).cast("float")
    assert knn.knn_by_expression(corpus, q, 1, first).where("q_id <> id").count() == 0


def test_merge_lists(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.7), (1, 3, 0.5), (1, 4, 0.9)], "list int, id long, distance float")
    assert [r.id for r in knn.merge_topk(df, 3).collect()] == [1, 3, 2]
    assert knn.merge_topk(df, 0).count() == 0
    assert knn.merge_topk(df, 99).count() == 4
    assert knn.merge_topk(df.limit(0), 3).count() == 0


def test_reachability_and_shape(spark):
    _, corpus = random_corpus(spark, 60)
    assert knn.unreachable(corpus, "l2").count() == 0
    twice = corpus.union(corpus.where("id = 5").withColumn("id", F.lit(1000).cast("long")))
    assert [(r.q_id, r.id) for r in knn.unreachable(twice, "l2").collect()] == [(1000, 5)]
    q = corpus.where("id < 3").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    found = knn.knn(corpus, q, 100, "l2")
    assert knn.shape_defects(found, corpus, q, 100).count() == 0
    assert knn.shape_defects(found.where("NOT (q_id = 1 AND rank = 4)"), corpus, q, 100).count() == 1


def test_graph_recall_symmetry_and_changes(spark):
    _, corpus = random_corpus(spark, 400, 16)
    p = hnsw.Params(m=8, ef_construction=60, ef_search=60)
    graph = hnsw.build(corpus, 2, "cosine", p).cache()
    assert graph.count() == 400
    assert hnsw.asymmetric_edges(graph).count() == 0
    q = corpus.where("id < 10").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    assert knn.recall(hnsw.search(graph, q, 10, "cosine", p), knn.knn(corpus, q, 10, "cosine")).first()["recall"] >= 0.95
    assert audit.set_difference(graph, corpus).count() == 0
    live = corpus.where("id % 4 <> 1")
    gone = corpus.where("id % 4 = 1").select("id")
    after = hnsw.apply_changes(graph, live, gone, 2, "cosine", p)
    assert audit.set_difference(after, live).count() == 0
    assert hnsw.search(after, q, 500, "cosine", p).groupBy("q_id").count().where("count <> 300").count() == 0
    assert hnsw.entry_point(graph).count() == 2
    with pytest.raises(EngineError):
        hnsw.Params(m=1)


def test_random_projections(spark):
    _, corpus = random_corpus(spark, 100)
    q = corpus.where("id < 5").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    found = lsh.search(corpus, q, 3, 10.0, bucket=4.0)
    assert {(r.q_id, r.id) for r in found.where("rank = 1").collect()} == {(i, i) for i in range(5)}


def test_vector_literals(spark):
    df = spark.createDataFrame([("1, 2.5 ,3",), ("x,1",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_vector(F.col("s"))).collect()] == [[1.0, 2.5, 3.0], None, None, None]


def test_search_query_set_grows_with_the_table(spark):
    from quillon.operators import knn
    from quillon.plans import fixtures, registry

    sf = "/root/testdata/sf0.001"
    found = registry.queries()["hnsw_search"](spark, sf).cache()
    corpus = fixtures.corpus(spark, sf)
    assert {r.q_id for r in found.collect()} == {r.id for r in corpus.collect() if r.id % 50 == 0}
    exact = {(r.q_id, r.id) for r in knn.knn(corpus, fixtures.queries_every(spark, sf, 50), 10, "cosine").collect()}
    assert len(exact & {(r.q_id, r.vec_id) for r in found.collect()}) >= 0.95 * len(exact)
