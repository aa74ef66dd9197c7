import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork import operators as O
from loomwork.core.pipeline import GraphBuilder, GraphModel, Pipeline, PipelineModel


def near(a, b, tol=1e-6):
    if isinstance(a, list | tuple | np.ndarray):
        return len(a) == len(b) and all(near(x, y, tol) for x, y in zip(a, b, strict=True))
    if math.isnan(a):
        return math.isnan(b)
    return abs(a - b) <= tol


@pytest.fixture(scope="module")
def points(spark):
    rows = [([float(x), 2.0, 3.0, 4.0], 0.0 if x <= 5 else 1.0, float(k % 5 + 1)) for k, x in enumerate([1, 2, 3, 4, 5, 11, 12, 13, 14, 15])]
    return spark.createDataFrame(rows, "features array<double>, label double, weight double").cache()


@pytest.mark.parametrize("batch", [32, 4])
def test_logistic_and_svc(spark, points, batch, tmp_path):
    for made in (O.LogisticRegression(weight_col="weight", max_iter=200, global_batch_size=batch), O.LinearSVC(weight_col="weight", max_iter=200, global_batch_size=batch)):
        m = made.fit(points)
        assert [(r.label, r.prediction) for r in m.transform(points).collect() if r.label != r.prediction] == []
    m = O.LogisticRegression(max_iter=5).fit(points)
    raw = m.transform(points).first().raw_prediction
    assert near(sum(raw), 1.0)
    m.save(spark, str(tmp_path / "lr"))
    assert O.LogisticRegressionModel.load(spark, str(tmp_path / "lr")).data["coefficient"] == m.data["coefficient"]
    bad = points.withColumn("label", F.lit(2.0))
    with pytest.raises(ValueError, match="0 or 1"):
        O.LogisticRegression().fit(bad)
    with pytest.raises(ValueError):
        O.LogisticRegression(multi_class="multinomial").fit(points)


def test_full_batch_against_numpy(spark, points):
    x = np.array([r.features for r in points.collect()])
    y = np.array([r.label for r in points.collect()])
    coef = np.zeros(4)
    for _ in range(3):
        grad = x.T @ (x @ coef - y)
        coef = coef - 0.001 / len(y) * grad
        coef = coef - 0.001 * 0.3 * (0.4 * np.sign(coef) + 0.6 * coef)
    m = O.LinearRegression(max_iter=3, learning_rate=0.001, global_batch_size=100, tol=0.0, reg=0.3, elastic_net=0.4).fit(points)
    assert near(m.data["coefficient"], coef, 1e-12)


def test_linear_regression(spark):
    rows = [([2.0, 1.0], 4.0, 1.0), ([3.0, 2.0], 7.0, 1.0), ([4.0, 3.0], 10.0, 1.0), ([2.0, 4.0], 10.0, 1.0), ([2.0, 2.0], 6.0, 1.0), ([4.0, 3.0], 10.0, 1.0), ([1.0, 2.0], 5.0, 1.0), ([5.0, 3.0], 11.0, 1.0)]
    df = spark.createDataFrame(rows, "features array<double>, label double, weight double")
    got = O.LinearRegression(weight_col="weight", max_iter=300).fit(df).transform(df).collect()
    assert all(abs(r.prediction - r.label) < 0.1 for r in got)


def test_naive_bayes(spark):
    df = spark.createDataFrame([([0.0, 0.0], 11), ([1.0, 0.0], 10), ([1.0, 1.0], 10)], "features array<double>, label int")
    m = O.NaiveBayes().fit(df)
    test = spark.createDataFrame([([0.0, 1.0],), ([0.0, 0.0],), ([1.0, 0.0],), ([1.0, 1.0],)], "features array<double>")
    assert [r.prediction for r in m.transform(test).collect()] == [11.0, 11.0, 10.0, 10.0]
    with pytest.raises(Exception, match="not in the model"):
        m.transform(spark.createDataFrame([([5.0, 1.0],)], "features array<double>")).collect()


def test_knn(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = (x[:, 0] * 4).astype(int).astype(float)
    train = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "features array<double>, label double").coalesce(1)
    queries = rng.random((40, 3))
    q = spark.createDataFrame([(v.tolist(),) for v in queries], "features array<double>")
    m = O.Knn(k=3).fit(train)
    got = [r.prediction for r in m.transform(q).collect()]
    want = []
    for v in queries:
        near_ = y[np.argsort(((x - v) ** 2).sum(axis=1), kind="stable")[:3]]
        kinds, n = np.unique(near_, return_counts=True)
        want.append(kinds[n.argmax()])
    assert got == want
    from loomwork.operators import classification as C

    old = C.BROADCAST_NUMBERS, C._BLOCK
    C.BROADCAST_NUMBERS, C._BLOCK = 10, 64
    try:
        blocks = {tuple(r.features): r.prediction for r in m.transform(q).collect()}
    finally:
        C.BROADCAST_NUMBERS, C._BLOCK = old
    assert [blocks[tuple(v.tolist())] for v in queries] == want
    again = O.KnnModel(k=3).set_model_data(m.get_model_data(spark))
    assert [r.prediction for r in again.transform(q).collect()] == want


def test_kmeans(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.0, 0.3],), ([0.3, 0.0],), ([9.0, 0.0],), ([9.0, 0.6],), ([9.6, 0.0],)], "features array<double>")
    for measure in ("euclidean", "manhattan"):
        m = O.KMeans(max_iter=5, seed=3, distance_measure=measure).fit(df)
        ids = [r.prediction for r in m.transform(df).collect()]
        assert len(set(ids[:3])) == 1 and len(set(ids[3:])) == 1 and ids[0] != ids[3]
        assert sorted(m.data["weights"]) == [3.0, 3.0]
    m = O.KMeans(max_iter=1, initial_centroids=[[0.0, 0.0], [100.0, 100.0]]).fit(df)
    assert math.isnan(m.data["centroids"][1][0])
    rng = np.random.default_rng(1)
    wide = spark.createDataFrame([(rng.random(80).tolist(),) for _ in range(50)], "features array<double>")
    m = O.KMeans(k=5, max_iter=3, seed=1).fit(wide)
    c, x = np.array(m.data["centroids"]), np.array([r.features for r in wide.collect()])
    assert [r.prediction for r in m.transform(wide).collect()] == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_agglomerative(spark, linkage):
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0, 4.0],), ([1.0, 0.0],), ([4.0, 1.5],), ([4.0, 4.0],), ([4.0, 0.0],)], "features array<double>").coalesce(1)
    rows, log = O.AgglomerativeClustering(linkage=linkage, num_clusters=2, compute_full_tree=True).transform(df)
    assert rows.count() == 6 and len({r.prediction for r in rows.collect()}) == 2
    merges = log.collect()
    assert len(merges) == 5 and merges[0].distance == 1.0 and merges[-1].sizeOfMergedCluster == 6
    rows, _ = O.AgglomerativeClustering(linkage=linkage, num_clusters=None, distance_threshold=1.0).transform(df)
    assert len({r.prediction for r in rows.collect()}) == 5
    with pytest.raises(ValueError):
        O.AgglomerativeClustering(linkage="ward", distance_measure="cosine").transform(df)


def test_swing(spark):
    pairs = [(0, 10), (0, 11), (0, 12), (1, 13), (1, 12), (2, 10), (2, 11), (2, 12), (3, 13), (3, 12), (4, 12), (4, 10), (4, 11), (4, 12), (4, 13)]
    df = spark.createDataFrame(pairs, "user long, item long")
    got = {r.item: [(int(x.split(",")[0]), float(x.split(",")[1])) for x in r.output.split(";")] for r in O.Swing(min_user_behavior=2, max_user_behavior=3, alpha1=15, alpha2=0, beta=0.3).transform(df).collect()}
    assert near(got[10][0][1], 0.058845768947156235) and [i for i, _ in got[10]] == [11, 12]
    assert near(dict(got[12])[13], 0.09134833828228624) and near(dict(got[13])[12], 0.09134833828228624)


def test_swing_crowded(spark):
    pairs = [(u, i) for u in range(6) for i in range(u % 3, 6)]
    df = spark.createDataFrame(pairs, "user long, item long")
    made = O.Swing(min_user_behavior=1, alpha1=1, max_user_num_per_item=6)
    want = {(r.item, r.other): r.score for r in made.scores(df).collect()}
    items = {u: {i for v, i in pairs if v == u} for u in range(6)}
    slow = {}
    for u in range(6):
        for v in range(u):
            both = items[u] & items[v]
            w = (1 / (1 + len(items[u]))) ** 0.3 * (1 / (1 + len(items[v]))) ** 0.3 / len(both)
            for i in both:
                for j in both - {i}:
                    slow[i, j] = slow.get((i, j), 0) + w
    assert want.keys() == slow.keys() and all(near(want[k], slow[k], 1e-12) for k in slow)
    few = {(r.item, r.other): r.score for r in made.set(max_user_num_per_item=4).scores(df).collect()}
    assert 0 < len(few) <= len(want) and all(few[k] <= want[k] + 1e-12 for k in few) and few != want


def test_chi_square(spark):
    rows = [(0.0, 5.0, 1.0), (2.0, 6.0, 2.0), (1.0, 7.0, 2.0), (1.0, 5.0, 4.0), (0.0, 5.0, 1.0), (2.0, 6.0, 2.0), (1.0, 7.0, 2.0), (1.0, 5.0, 4.0), (2.0, 5.0, 1.0), (0.0, 5.0, 2.0), (0.0, 5.0, 2.0), (1.0, 9.0, 4.0), (1.0, 9.0, 3.0)]
    df = spark.createDataFrame([(a, [b, c]) for a, b, c in rows], "label double, features array<double>")
    r = O.ChiSqTest().transform(df).first()
    assert near(r.statistics, [13.61904761905, 7.94444444444], 1e-10) and r.degreesOfFreedom == [6, 6]
    assert near(r.pValues, [0.03419350755, 0.24220177737], 1e-10)
    assert O.ChiSqTest(flatten=True).transform(df).count() == 2


def test_anova_and_f(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 3))
    label = rng.integers(0, 3, 40).astype(float)
    x[:, 0] += label
    df = spark.createDataFrame([(float(y), v.tolist()) for v, y in zip(x, label, strict=True)], "label double, features array<double>")
    r = O.ANOVATest().transform(df).first()
    for k in range(3):
        groups = [x[label == g, k] for g in (0, 1, 2)]
        between = sum(len(g) * (g.mean() - x[:, k].mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 37
        assert near(r.fValues[k], between / within, 1e-8)
    assert r.degreesOfFreedom == [39] * 3 and r.pValues[0] < 1e-6 < r.pValues[1]
    r = O.FValueTest().transform(df).first()
    c = np.corrcoef(x[:, 0], label)[0, 1]
    assert near(r.fValues[0], c * c / (1 - c * c) * 38, 1e-7) and r.degreesOfFreedom == [38] * 3
    s = O.UnivariateFeatureSelector(feature_type="continuous", label_type="categorical", selection_threshold=1.0)
    assert s.fit(df).data["indices"] == [0]
    assert s.set(selection_mode="fpr", selection_threshold=1e-5).fit(df).data["indices"] == [0]
    assert s.set(selection_mode="fwe", selection_threshold=0.0).fit(df).data["indices"] == []


def test_tails():
    from loomwork.functions.tails import chi_square, f_tail

    assert near(chi_square(3.841458820694124, 1), 0.05, 1e-10) and near(f_tail(4.964602743730711, 1, 10), 0.05, 1e-9)


def test_evaluator(spark):
    rows = [(1.0, 0.9), (1.0, 0.8), (1.0, 0.7), (0.0, 0.75), (0.0, 0.6), (1.0, 0.55), (1.0, 0.3), (0.0, 0.35), (0.0, 0.4), (1.0, 0.1)]
    df = spark.createDataFrame(rows, "label double, raw_prediction double")
    names = ["areaUnderROC", "areaUnderPR", "areaUnderLorenz", "ks"]
    got = O.BinaryClassificationEvaluator(metrics_names=names).transform(df).first()
    order = sorted(rows, key=lambda r: -r[1])
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    tp = fp = roc = pr = lorenz = ks = 0.0
    precision = 1.0
    for y, _ in order:
        t, f = tp + y, fp + 1 - y
        now = t / (t + f)
        roc += (f - fp) / n * (t + tp) / p / 2
        pr += (t - tp) / p * (precision + now) / 2
        lorenz += 1 / len(rows) * (t + tp) / p / 2
        ks = max(ks, abs(t / p - f / n))
        tp, fp, precision = t, f, now
    assert near(list(got), [roc, pr, lorenz, ks], 1e-9)
    twice = df.unionByName(df)
    assert near(O.BinaryClassificationEvaluator().transform(twice).first().areaUnderROC, 0.0 + O.BinaryClassificationEvaluator().transform(df.withColumn("w", F.lit(2.0)).withColumn("raw_prediction", F.col("raw_prediction"))).first().areaUnderROC, 0.2)
    weighted = O.BinaryClassificationEvaluator(weight_col="w").transform(df.withColumn("w", F.lit(3.0))).first()
    assert near(weighted.areaUnderROC, roc, 1e-9)


def test_pipeline_and_graph(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 9.0)], "a double, b double")
    stages = [O.VectorAssembler(input_cols=["a", "b"], output_col="v"), O.StandardScaler(input_col="v", output_col="s"), O.Normalizer(input_col="s", output_col="n")]
    m = Pipeline(stages).fit(df)
    want = [r.n for r in m.transform(df).collect()]
    assert near(np.linalg.norm(want, axis=1), [1.0] * 3)
    m.save(spark, str(tmp_path / "p"))
    assert [r.n for r in PipelineModel.load(spark, str(tmp_path / "p")).transform(df).collect()] == want
    g = GraphBuilder()
    t = g.create_table_id()
    a = g.add_algo_operator(stages[0], t)[0]
    s = g.add_estimator(stages[1], a)[0]
    n = g.add_algo_operator(stages[2], s)[0]
    data = g.get_model_data(stages[1])[0]
    with pytest.raises(ValueError):
        g.add_algo_operator(stages[0], t)
    made = g.build_estimator([t], [n, data]).fit(df)
    out, model = made.transform(df)
    assert [r.n for r in out.collect()] == want and near(model.first().mean, [2.0, 6.0])
    made.save(spark, str(tmp_path / "g"))
    again = GraphModel.load(spark, str(tmp_path / "g"))
    assert [r.n for r in again.transform(df)[0].collect()] == want
