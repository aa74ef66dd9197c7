"""Small tables with published results."""

import math

import numpy as np
import pytest

from loomwork import operators as O
from loomwork.streaming.online import OnlineLogisticRegression
from loomwork.streaming.windows import CountTumblingWindows


def near(a, b, tol=1e-6):
    return np.allclose(np.array(a, float), np.array(b, float), atol=tol, rtol=0, equal_nan=True)


METRICS = ["areaUnderROC", "areaUnderPR", "ks", "areaUnderLorenz"]


@pytest.mark.parametrize(
    ("scores", "weights", "want"),
    [
        ([0.9, 0.8, 0.7, 0.75, 0.6, 0.65, 0.55, 0.4, 0.3, 0.35, 0.2, 0.1], None, {"areaUnderPR": 0.7691481137909708, "ks": 0.3714285714285714, "areaUnderROC": 0.6571428571428571}),
        ([0.9, 0.9, 0.9, 0.75, 0.6, 0.9, 0.9, 0.4, 0.3, 0.9, 0.2, 0.1], None, {"areaUnderROC": 0.8571428571428571, "areaUnderPR": 0.9377705627705628, "ks": 0.8571428571428571, "areaUnderLorenz": 0.6488095238095237}),
        ([0.9, 0.9, 0.9, 0.75, 0.6, 0.9, 0.9, 0.4, 0.3, 0.9, 0.2, 0.1], [0.8, 0.7, 0.5, 1.2, 1.3, 1.5, 1.4, 0.3, 0.5, 1.9, 1.2, 1.0], {"areaUnderROC": 0.8717948717948718, "areaUnderPR": 0.9510202726261435}),
    ],
)
def test_binary_metrics(spark, scores, weights, want):
    labels = [1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0]
    rows = [(y, [1 - s, s], w) for y, s, w in zip(labels, scores, weights or [1.0] * 12, strict=True)]
    df = spark.createDataFrame(rows, "label double, raw_prediction array<double>, weight double")
    got = O.BinaryClassificationEvaluator(metrics_names=list(want), **({"weight_col": "weight"} if weights else {})).transform(df).first()
    assert near([got[k] for k in want], list(want.values()))


SPARSE = [(3, [6.0, 7.0, 0.0, 7.0, 6.0, 0.0, 0.0]), (1, [0.0, 9.0, 6.0, 0.0, 5.0, 9.0, 0.0]), (3, [0.0, 9.0, 3.0, 0.0, 5.0, 5.0, 0.0]), (2, [0.0, 9.0, 8.0, 5.0, 6.0, 4.0, 0.0]), (2, [8.0, 9.0, 6.0, 5.0, 4.0, 4.0, 0.0]), (3, [math.nan, 9.0, 6.0, 4.0, 0.0, 0.0, 0.0])]


def test_anova_with_nan(spark):
    r = O.ANOVATest().transform(spark.createDataFrame(SPARSE, "label int, features array<double>")).first()
    assert near(r.pValues, [math.nan, 0.71554175, 0.34278574, 0.45824059, 0.84633632, 0.15673368, math.nan])
    assert near(r.fValues, [math.nan, 0.375, 1.5625, 1.02364865, 0.17647059, 3.66, math.nan]) and r.degreesOfFreedom == [5] * 7


@pytest.mark.parametrize(
    ("linkage", "measure", "want"),
    [("average", "euclidean", [1, 1.5, 3, 3.1394402, 3.9559706]), ("average", "cosine", [0, 0, 0.0636708, 0.1425070, 0.3664484]), ("average", "manhattan", [1, 1.5, 3, 3.75, 4.875]), ("single", "euclidean", [1, 1.5, 2.5, 3, 3]), ("ward", "euclidean", [1, 1.5, 3, 4.2573465, 5.5113519]), ("complete", "euclidean", [1, 1.5, 3, 3.3541019, 5])],
)
def test_merge_distances(linkage, measure, want):
    x = np.array([[1, 1], [1, 4], [1, 0], [4, 4], [4, 1.5], [4, 0]], float)
    a = O.AgglomerativeClustering(linkage=linkage, distance_measure=measure)
    assert near([m[2] for m in a.merges(x)], want)
    if linkage == "ward":
        assert a.cluster(x)[0].tolist() == [0, 1, 0, 1, 0, 0]
        assert a.set(num_clusters=None, distance_threshold=2.0).cluster(x)[0].tolist() == [0, 1, 0, 2, 3, 3]


def test_count_windows_of_clusters(spark):
    rows = [(k, v) for k, v in enumerate([[1.0, 1.0], [1.0, 4.0], [1.0, 0.0], [4.0, 4.0], [4.0, 1.5], [4.0, 0.0]])]
    df = spark.createDataFrame(rows, "k long, features array<double>").coalesce(1)
    out, _ = O.AgglomerativeClustering(windows=CountTumblingWindows(5), time_col="k").transform(df)
    assert {r.k: r.prediction for r in out.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1}


def test_imputer_values(spark):
    rows = [(math.nan, 9.0, 1, 9.0), (1.0, 9.0, None, 9.0), (1.5, 7.0, 1, 7.0), (1.5, math.nan, 2, math.nan), (4.0, 5.0, 4, 5.0), (None, 4.0, None, 4.0)]
    df = spark.createDataFrame(rows, "f1 double, f2 double, f3 int, f4 float").coalesce(1)
    names = ["f1", "f2", "f3", "f4"]
    for strategy, want in (("mean", [2.0, 6.8, 2.0, 6.8]), ("median", [1.5, 7.0, 1.0, 7.0]), ("most_frequent", [1.5, 9.0, 1.0, 9.0])):
        m = O.Imputer(input_cols=names, output_cols=["a", "b", "c", "d"], strategy=strategy).fit(df)
        assert near([m.data["surrogates"][n] for n in names], want)
        first, last = (m.transform(df).collect()[k] for k in (0, 5))
        assert near([first.a, first.b, first.c, first.d], [want[0], 9.0, 1.0, 9.0]) and near([last.a, last.c], [want[0], want[2]])


def test_online_logistic_values(spark):
    one = [([0.1, 2.0], 0.0), ([0.2, 2.0], 0.0), ([0.3, 2.0], 0.0), ([0.4, 2.0], 0.0), ([0.5, 2.0], 0.0), ([11.0, 12.0], 1.0), ([12.0, 11.0], 1.0), ([13.0, 12.0], 1.0), ([14.0, 12.0], 1.0), ([15.0, 12.0], 1.0)]
    two = [([0.2, 3.0], 0.0), ([0.8, 1.0], 0.0), ([0.7, 1.0], 0.0), ([0.6, 2.0], 0.0), ([0.2, 2.0], 0.0), ([14.0, 17.0], 1.0), ([15.0, 10.0], 1.0), ([16.0, 16.0], 1.0), ([17.0, 10.0], 1.0), ([18.0, 13.0], 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(one + two)], "k long, features array<double>, label double")
    made = OnlineLogisticRegression(reg=0.2, elastic_net=0.5, global_batch_size=10, initial_model=[0.41233679404769874, -0.18088118293232122], order_col="k").fit_versions(df)
    assert near(made[0].data["coefficient"], [0.2994527071464283, -0.1412541067743284], 1e-5)
    test = spark.createDataFrame([([0.8, 2.7],), ([15.5, 11.2],)], "features array<double>").coalesce(1)
    for m, want in zip(made, ([[0.5353966697318491, 0.4646033302681509], [0.04481034155642882, 0.9551896584435712]], [[0.5095144380001769, 0.49048556199982307], [0.013104324065967066, 0.9868956759340329]]), strict=True):
        assert near([r.raw_prediction for r in m.transform(test).collect()], want, 1e-5)


def test_online_logistic_sparse_values(spark):
    one = [([1, 3, 4], 0.0), ([0, 2, 3], 0.0), ([0, 3, 4], 0.0), ([2, 3, 4], 0.0), ([1, 3, 4], 0.0), ([6, 7, 8], 1.0), ([6, 8, 9], 1.0), ([5, 8, 9], 1.0), ([5, 6, 7], 1.0)]
    two = [([1, 2, 4], 0.0), ([2, 3, 4], 0.0), ([0, 2, 4], 0.0), ([1, 3, 4], 0.0), ([6, 7, 9], 1.0), ([7, 8, 9], 1.0), ([5, 7, 9], 1.0), ([5, 6, 7], 1.0), ([5, 8, 9], 1.0)]
    kind = "features struct<size int, indices array<int>, values array<double>>"
    df = spark.createDataFrame([(k, (10, at, [1.0] * 3), y) for k, (at, y) in enumerate(one + two)], f"k long, {kind}, label double")
    made = OnlineLogisticRegression(reg=0.2, elastic_net=0.5, global_batch_size=9, initial_model=[0.01] * 10, order_col="k").fit_versions(df)
    test = spark.createDataFrame([((10, [1, 3, 5], [1.0] * 3),), ((10, [5, 8, 9], [1.0] * 3),)], kind).coalesce(1)
    for m, want in zip(made, ([[0.5105551725414953, 0.4894448274585047], [0.4452309884735286, 0.5547690115264714]], [[0.5249618837373886, 0.4750381162626114], [0.40310431554310666, 0.5968956844568933]]), strict=True):
        assert near([r.raw_prediction for r in m.transform(test).collect()], want, 1e-5)


def test_minhash_values(spark):
    kind = "id int, vec struct<size int, indices array<int>, values array<double>>"
    a = spark.createDataFrame([(0, (6, [0, 1, 2], [1.0] * 3)), (1, (6, [2, 3, 4], [1.0] * 3)), (2, (6, [0, 2, 4], [1.0] * 3))], kind).coalesce(1)
    b = spark.createDataFrame([(3, (6, [1, 3, 5], [1.0] * 3)), (4, (6, [2, 3, 5], [1.0] * 3)), (5, (6, [1, 2, 4], [1.0] * 3))], kind)
    m = O.MinHashLSH(input_col="vec", output_col="hashes", seed=2022, num_hash_tables=5).fit(a)
    assert [[h[0] for h in r.hashes] for r in m.transform(a).collect()] == [
        [173046954.0, 157275425.0, 67798584.0, 638582806.0, 178703694.0],
        [173046954.0, 157275425.0, 690717571.0, 502301169.0, 796714100.0],
        [173046954.0, 157275425.0, 690717571.0, 1453197722.0, 796714100.0],
    ]
    assert {(r.id_a, r.id_b, r.distCol) for r in m.approx_similarity_join(a, b, 0.6, "id").collect()} == {(1, 4, 0.5), (0, 5, 0.5), (1, 5, 0.5), (2, 5, 0.5)}
    fixed = O.MinHashLSHModel(input_col="vec").with_data(numHashTables=3, numHashFunctionsPerTable=1, randCoefficientA=[0, 1, 3], randCoefficientB=[1, 2, 0])
    one = spark.createDataFrame([(0, (10, [2, 3, 5, 7], [1.0] * 4))], kind)
    assert fixed.transform(one).first().output == [[1.0], [5.0], [9.0]]
    with pytest.raises(Exception, match="non-zero"):
        fixed.transform(spark.createDataFrame([(0, (10, [], []))], kind)).collect()
