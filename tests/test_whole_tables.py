import numpy as np

from loomwork.plans import queries

SF = "/root/testdata/sf0.001"


def test_agglomerative_covers_the_table(spark):
    rows = queries.load(spark, SF, "embeddings").select("vec_id").collect()
    got = queries.agglomerative_clustering(spark, SF).collect()
    assert sorted(r.vec_id for r in got) == sorted(r.vec_id for r in rows)
    assert {r.prediction for r in got} == set(range(5))


def test_knn_predicts_every_row(spark):
    rows = sorted(queries.load(spark, SF, "embeddings").collect(), key=lambda r: r.vec_id)
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float)
    want = {}
    for r, v in zip(rows, x, strict=True):
        kinds, n = np.unique(y[np.argsort(np.round(((x - v) ** 2).sum(axis=1), 9), kind="stable")[:5]], return_counts=True)
        want[r.vec_id] = kinds[n.argmax()]
    assert {r.vec_id: r.prediction for r in queries.knn_all(spark, SF).collect()} == want


def test_random_splitter_keeps_every_row(spark):
    rows = queries.load(spark, SF, "lineitem").select(*queries.KEY).collect()
    got = queries.QUERIES["random_splitter"](spark, SF).collect()
    assert sorted((r.l_orderkey, r.l_linenumber) for r in got) == sorted(map(tuple, rows))
    share = sum(r.part == 0 for r in got) / len(got)
    assert {r.part for r in got} == {0, 1} and 0.7 < share < 0.8
