import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import distance
from quillon.operators import knn
from tests.test_vectors import INF, NAN, random_corpus, vectors


@pytest.mark.parametrize("way", ["expression", "sharded"])
def test_kernel_finds_what_expressions_measure(spark, monkeypatch, way):
    """A named metric's pairs aren't all measured by the expression; odd rows rank as it says."""
    m, corpus = random_corpus(spark, 200)
    odd = vectors(spark, [(900, [1.0]), (901, [NAN] * 8), (902, [INF] * 8), (903, [])]).union(spark.createDataFrame([(904, None)], "id long, vec array<float>"))
    q = corpus.where("id < 5").select(F.col("id").alias("q_id"), F.col("vec").alias("q"))
    q = q.union(spark.createDataFrame([(77, [1.0, 2.0])], "q_id long, q array<float>"))
    search = lambda c, metric: (knn.knn_by_expression(c, q, 6, metric) if way == "expression" else knn.knn_sharded(c, q, 6, metric, 3))
    rows = lambda df: sorted((r.q_id, r["rank"], r.id, str(r.distance)) for r in df.collect())
    both = corpus.union(odd)
    seen, real = [], knn._kernel
    monkeypatch.setattr(knn, "_kernel", lambda c, asked, k, metric: seen.append(asked.num_rows) or real(c, asked, k, metric))
    for metric in ("cosine", "l2", "dot"):
        assert rows(search(both, metric)) == rows(search(both, distance.METRICS[metric]))
    assert len(seen) == 3 and set(seen) == {5}
    assert search(corpus.limit(0), "l2").count() == 0
    assert np.isfinite(m).all()


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_build_measures_rows_instead_of_scanning(monkeypatch, metric):
    from quillon.operators import hnsw

    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    p = hnsw.Params(m=8, ef_construction=40, ef_search=40)
    g = hnsw.Graph(np.arange(300) * 3, v, metric, p)
    for row in (1, 39, 40, 41, 299):
        want = sorted((float(d), i) for i, d in enumerate(g.near(g.points[row], list(range(row)))))[:40]
        got = g.measured(row, 40)
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want])
    scans, real = [], hnsw.Graph.scan
    monkeypatch.setattr(hnsw.Graph, "scan", lambda self, q, at, ef, layer: scans.append(layer) or real(self, q, at, ef, layer))
    for most in (1 << 17, 0):
        monkeypatch.setattr(hnsw, "MEASURED", most)
        scans.clear()
        g = hnsw.Graph.build(np.arange(300), v, metric, p)
        assert (0 in scans) == (most == 0)
        assert all(a in g.links[b][layer] for a, x in enumerate(g.links) for layer, near in enumerate(x) for b in near)
        assert all(len(near) <= p.cap(layer) for x in g.links for layer, near in enumerate(x))
