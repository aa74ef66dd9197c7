import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.plans import dataflow as D
from loomwork.plans.iteration import Iteration, Listener, Round, max_iter, max_iter_or_tol
from loomwork.sources import generators as G
from loomwork.streaming import online as S
from loomwork.streaming import windows as W

ROWS = [(0, [-2.5, 9.0, 1.0]), (1000, [1.4, -5.0, 1.0]), (2000, [2.0, -1.0, -2.0]), (6000, [0.7, 3.0, 1.0]), (7000, [0.0, 1.0, 1.0]), (8000, [0.5, 0.0, -2.0]), (9000, [0.4, 1.0, 1.0]), (10000, [0.3, 2.0, 1.0]), (11000, [0.5, 1.0, -2.0])]


def near(a, b, tol=1e-6):
    return np.allclose(np.array(a, float), np.array(b, float), atol=tol, rtol=0)


@pytest.fixture(scope="module")
def timed(spark):
    return spark.createDataFrame(ROWS, "id long, input array<double>").withColumn("ts", F.timestamp_millis("id")).cache()


@pytest.mark.parametrize(("window", "n"), [(W.EventTimeTumblingWindows(3000), 3), (W.CountTumblingWindows(3), 3), (W.CountTumblingWindows(4), 2), (W.EventTimeSessionWindows(2000), 2), (W.GlobalWindows(), 1)])
def test_online_scaler(spark, timed, window, n):
    s = S.OnlineStandardScaler(windows=window, time_col="ts")
    got = s.versions(timed).orderBy("version").collect()
    assert len(got) == n and [r.version for r in got] == list(range(n))
    if isinstance(window, W.EventTimeTumblingWindows) or window == W.CountTumblingWindows(3):
        assert near(got[0]["mean"], [0.3, 1, 0]) and near(got[0]["std"], [2.4433583, 7.2111026, 1.7320508])
        assert near(got[1]["mean"], [0.35, 1.1666667, 0]) and near(got[2]["std"], [1.2369316, 3.7006005, 1.5])
    if isinstance(window, W.EventTimeTumblingWindows):
        assert [r.timestamp for r in got] == [2999, 8999, 11999]


def test_model_delay(spark, timed):
    s = S.OnlineStandardScaler(windows=W.EventTimeTumblingWindows(3000), time_col="ts", max_allowed_model_delay_ms=0)
    got = s.fit(timed).transform(timed).orderBy("id").collect()
    assert [r.version for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    late = S.OnlineStandardScaler(windows=W.EventTimeTumblingWindows(3000), time_col="ts", max_allowed_model_delay_ms=4000).fit(timed)
    assert [r.version for r in late.transform(timed).orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_scaler_stream(spark, timed, tmp_path):
    source, store = str(tmp_path / "in"), S.ModelStore(spark, str(tmp_path / "store"))
    timed.where("id < 7500").coalesce(1).write.mode("append").parquet(source)
    s = S.OnlineStandardScaler(windows=W.EventTimeTumblingWindows(3000), time_col="ts")
    read = lambda: spark.readStream.schema(timed.schema).parquet(source)
    s.fit_stream(read(), store, str(tmp_path / "cp")).awaitTermination()
    timed.where("id >= 7500").coalesce(1).write.mode("append").parquet(source)
    s.fit_stream(read(), store, str(tmp_path / "cp")).awaitTermination()
    got = s.stored(spark, store).versions.orderBy("version").collect()
    assert [r.timestamp for r in got] == [2999, 8999] and near(got[1]["std"], [1.5630099, 4.6654760, 1.5491933])


def test_online_kmeans(spark, tmp_path):
    rows = [(k, [10.0 + x, 0.0]) if k % 2 else (k, [x, 0.3]) for k, x in enumerate([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 4.0, 4.1, 4.2, 4.3, 4.4])]
    df = spark.createDataFrame(rows, "k long, features array<double>")
    s = S.OnlineKMeans(initial_model=([[0.0, 0.0], [10.0, 0.0]], [0.0, 0.0]), global_batch_size=6, decay_factor=0.5, order_col="k")
    made = s.fit_versions(df)
    assert len(made) == 1 and near(made[0].data["centroids"], [[0.2, 0.3], [10.3, 0.0]]) and made[0].data["weights"] == [3.0, 3.0]
    store = S.ModelStore(spark, str(tmp_path / "s"))
    for k, part in enumerate((df.where("k < 4"), df.where("k >= 4"))):
        part.coalesce(1).sortWithinPartitions("k").write.mode("append").parquet(str(tmp_path / "in"))
        s.fit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
        assert len(store.all()) == k + 1
    assert near(s.stored_versions(store)[0].data["centroids"], made[0].data["centroids"])
    assert near([r.prediction for r in made[0].transform(df).collect()], [k % 2 for k in range(11)])


def test_online_logistic(spark):
    rows = [(k, [float(x), 2.0], 0.0 if x < 5 else 1.0) for k, x in enumerate([1, 2, 3, 4, 11, 12, 13, 14] * 6)]
    df = spark.createDataFrame(rows, "k long, features array<double>, label double")
    s = S.OnlineLogisticRegression(initial_model=[0.01, 0.01], global_batch_size=16, order_col="k", reg=0.1, elastic_net=0.5)
    made = s.fit_versions(df)
    assert [m.data["modelVersion"] for m in made] == [1, 2, 3]
    x, y = np.array([r[1] for r in rows[:16]]), np.array([r[2] for r in rows[:16]])
    g = ((1 / (1 + np.exp(-x @ [0.01, 0.01])) - y) @ x) / 16
    z = g - np.abs(g) / 0.1 * 0.01
    want = (np.sign(z) * 0.05 - z) / ((0.1 + np.abs(g)) / 0.1 + 0.05)
    assert near(made[0].data["coefficient"], np.where(np.abs(z) <= 0.05, 0, want), 1e-9)
    assert made[-1].transform(df).first().modelVersion == 3


def test_windows_as_parameters():
    w = W.CountTumblingWindows(5)
    assert W.Window.from_dict(w.to_dict()) == w
    with pytest.raises(ValueError):
        W.EventTimeTumblingWindows(5).assign(None)


def test_dataflow(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x")).repartition(7)
    add = lambda f: f.groupby(lambda _: 0).agg({"k": "min", "x": "sum"})
    assert D.reduce_all(df, add).first().x == 4950.0
    assert D.reduce_all(df.limit(0), add).count() == 0
    assert D.aggregate(df, lambda: 0.0, lambda a, f: a + f["x"].sum(), lambda a, b: a + b, lambda a: a / 2) == 2475.0
    assert D.aggregate(df.limit(0), lambda: 0.0, lambda a, f: a + f["x"].sum(), lambda a, b: a + b, lambda a: a) == 0.0
    assert D.sample(df, 10, 1).count() == 10 and D.sample(df, 10, 1).collect() == D.sample(df, 10, 1).collect()
    arrays = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "a array<double>")
    assert D.all_reduce_sum(arrays, "a").tolist() == [4.0, 6.0]
    ranked = D.global_rank(df, [F.col("x")], "r").collect()
    assert all(r.r == r.x for r in ranked) and len(ranked) == 100
    assert D.batches(df, [F.col("x")], 30).groupBy("batch").count().count() == 3
    left, right = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(2, 5), (3, 7)], "k int, b int")

    def join(a, b):
        import pandas as pd

        return pd.DataFrame({"n": [len(a)], "m": [len(b)]})

    assert sorted(map(tuple, D.co_group(left, right, "k", "k", join, "n int, m int").collect())) == [(0, 1), (1, 0), (1, 1)]
    out = D.with_broadcast(df, {"top": df.agg(F.max("x"))}, lambda d, b: d.where(F.col("x") == b["top"].value[0][0]))
    assert out.count() == 1


def test_iteration(spark):
    seen = []
    body = lambda e, v, data: Round(v + data[0].count(), max_iter(3)(e, None))
    out, _ = Iteration(body, [Listener(on_round=lambda e, v: seen.append((e, v)))]).run(0, [spark.range(5)])
    assert out == 15 and seen == [(0, 5), (1, 10), (2, 15)]
    assert not max_iter_or_tol(5, 0.1)(0, 0.05) and max_iter_or_tol(5, 0.1)(0, 0.5)
    grown, _ = Iteration(lambda e, v, d: Round(v.withColumn("id", F.col("id") + 1), e < 5), cut_every=2).run(spark.range(3))
    assert sorted(r.id for r in grown.collect()) == [6, 7, 8]


def test_generators(spark):
    for made in (G.DenseVectorGenerator(num_values=20, vector_dim=3, seed=2), G.DenseVectorArrayGenerator(num_values=5, vector_dim=2, array_size=3), G.DoubleGenerator(num_values=50, arity=4, col_names=[["a", "b"]]), G.RandomStringGenerator(num_values=9), G.RandomStringArrayGenerator(num_values=9, array_size=4), G.LabeledPointWithWeightGenerator(num_values=30, feature_arity=0, label_arity=2)):
        df = made.generate(spark)
        assert G.count_and_discard(df) == made.num_values and df.collect() == made.generate(spark).collect()
    assert len(G.KMeansModelDataGenerator(vector_dim=4, array_size=3).generate(spark).first().centroids) == 3
