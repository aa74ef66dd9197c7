"""What grows with the input: work, memory of a task, rows that reach the driver."""

import numpy as np
from pyspark.sql import functions as F

from loomwork import operators as O
from loomwork.operators import classification as C
from loomwork.plans.queries import QUERIES


def test_neighbours_by_products(monkeypatch):
    """The k best by a matrix product and few distances, also with equal vectors and equal distances."""
    rng, seen = np.random.default_rng(5), []
    take = C._Best._take
    monkeypatch.setattr(C._Best, "_take", lambda self, q, *rest: (seen.append(len(q)), take(self, q, *rest)))
    for x in (rng.normal(size=(1500, 16)) + 100, rng.integers(0, 3, (700, 3)).astype(float)):
        best = C._Best(x, 4)
        for a in range(0, len(x), 400):
            best.meet(x[a : a + 400], np.arange(len(x))[a : a + 400], np.zeros(len(x))[a : a + 400])
        slow = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert (best.at == np.argsort(slow, axis=1, kind="stable")[:, :4]).all()
        if x.shape[1] == 16:
            assert sum(seen) < 20 * len(x)


def test_neighbours_of_equal_vectors(spark, monkeypatch):
    """Blocks keep the earliest of equal vectors only; both ways give the votes of all rows."""
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array((F.col("id") % 50).cast("double"), F.lit(0.0))).alias("features"), (F.col("id") % 7).cast("double").alias("label"), "id")
    m = O.Knn(k=3).fit(df.orderBy("id"))
    got = {r.id: r.prediction for r in m.transform(df).collect()}
    monkeypatch.setattr(C, "BROADCAST_NUMBERS", 100)
    assert got == {r.id: r.prediction for r in m.transform(df).collect()}
    rows = df.orderBy("id").collect()
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    near = np.argsort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1, kind="stable")[:, :3]
    assert got == {r.id: C._vote(y[near[k]]) for k, r in enumerate(rows)}


def test_training_rows_stay_spread(spark, monkeypatch):
    """The query sorts its training rows in ranges, not in one task."""
    plans, fit = [], O.Knn.fit
    monkeypatch.setattr(O.Knn, "fit", lambda self, df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), fit(self, df))[1])
    for name in ("knn", "knn_all"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Repartition 1," in p for p in plans)


def _learns_in_tasks(spark, monkeypatch, learner, label):
    """The versions that row by row learning gives, without rows on the driver; batches cross the ranges."""
    from pyspark.sql import DataFrame

    df = spark.range(0, 5000, 1, 7).select("id", F.array(F.rand(1), F.rand(2)).alias("features"), F.when(F.rand(3) > 0.5, 1.0).otherwise(0.0).alias("label")).persist()
    rows = df.orderBy("id").collect()
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a: 1 / 0)
    made = learner.fit_versions(df)
    state = learner.initial()
    for k in range(16):
        part = rows[300 * k : 300 * k + 300]
        state = learner.update(state, *learner._arrays([(r.features, r.label, 0.0) for r in part]))
        assert made[k].need()[label] == state[{"coefficient": "coef"}.get(label, label)]
    assert len(made) == 16 and learner.fit(df).need()[label] == made[-1].need()[label]


def test_online_kmeans_in_tasks(spark, monkeypatch):
    from loomwork.streaming.online import OnlineKMeans

    _learns_in_tasks(spark, monkeypatch, OnlineKMeans(k=2, initial_model=([[0.2, 0.2], [0.7, 0.9]], [0.0, 0.0]), global_batch_size=300, order_col="id"), "centroids")


def test_online_logistic_regression_in_tasks(spark, monkeypatch):
    from loomwork.streaming.online import OnlineLogisticRegression

    _learns_in_tasks(spark, monkeypatch, OnlineLogisticRegression(initial_model=[0.0, 0.0], global_batch_size=300, order_col="id", reg=0.01), "coefficient")


def test_quantile_bins_of_all_rows(spark):
    """Edges of all rows, above the bound of what is ranked at once, too."""
    df = spark.range(5000).select(F.array(F.round(F.rand(4) * 1000, 1), F.floor(F.rand(5) * 5).cast("double")).alias("input")).persist()
    edges = [O.KBinsDiscretizer(strategy="quantile", num_bins=4, sub_samples=n).fit(df).need()["binEdges"] for n in (10000, 100)]
    assert edges[0] == edges[1]


def test_exact_quantiles_from_small_sketches(spark, monkeypatch):
    """A tiny relative error asks for no huge sketch; the quantiles are those of the sorted values."""
    from loomwork.core import vectors as V

    approx = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, accuracy=10000: approx(c, p, accuracy) if accuracy <= 10000 else 1 / 0)
    df = spark.range(3001).select(F.array(F.randn(1), F.floor(F.rand(2) * 3).cast("double")).alias("input"), F.randn(4).alias("a")).persist()
    for few in (V.FEW_ROWS, 40):
        monkeypatch.setattr(V, "FEW_ROWS", few)
        made = O.RobustScaler(relative_error=1e-7).fit(df).need()
        x = np.sort(np.array([r.input for r in df.collect()]), axis=0)
        assert made["medians"] == x[1500].tolist() and made["ranges"] == (x[2250] - x[750]).tolist()
        got = O.Imputer(input_cols=["a"], output_cols=["b"], strategy="median", relative_error=1e-7).fit(df).need()["surrogates"]["a"]
        assert got == sorted(r.a for r in df.collect())[1500]


def test_counting_in_pieces(monkeypatch):
    """Lists are counted piece by piece of bounded length; together they are the whole batch."""
    import pyarrow as pa
    from loomwork.operators import text as X

    docs = pa.array([["a"] * 3, [], None, ["b"] * 9, ["c", "d"], ["e"]], pa.list_(pa.string()))
    monkeypatch.setattr(X, "_TOKENS", 4)
    parts = list(X.slices(docs))
    assert pa.concat_arrays(parts).equals(docs) and [len(p) for p in parts] == [3, 1, 2]
    assert len(X.joined([])) == 0


def test_swing_of_one_item():
    """Common, middling and rare items of the users of one item give the sums over all pairs."""
    import pyarrow as pa
    from loomwork.operators.recommendation import _item_scores

    rng = np.random.default_rng(0)
    for users, few, kinds in ((30, 6, 12), (90, 20, 90)):
        items = [np.unique(np.append(rng.choice(kinds, few, replace=False), 7)) for _ in range(users)]
        w, slow = rng.random(users) + 0.1, {}
        got = dict(zip(*map(np.ndarray.tolist, _item_scores(7, w, pa.array([x.tolist() for x in items], pa.list_(pa.int64())), 1)), strict=True))
        for a in range(users):
            for b in range(a + 1, users):
                both = set(items[a].tolist()) & set(items[b].tolist())
                for j in both - {7}:
                    slow[j] = slow.get(j, 0) + w[a] * w[b] / (1 + len(both))
        assert got.keys() == slow.keys() and all(abs(got[j] - slow[j]) < 1e-9 for j in slow)
