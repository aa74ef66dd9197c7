import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loomwork import operators as O


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def near(a, b, tol=1e-7):
    if isinstance(a, list | tuple):
        return len(a) == len(b) and all(near(x, y, tol) for x, y in zip(a, b, strict=True))
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return abs(a - b) <= tol


def test_params():
    s = O.StandardScaler(input_col="x", with_mean=True)
    assert s.get_input_col() == "x" and s.output_col == "output" and s.with_std
    s.set_output_col("y")
    assert s.output_col == "y"
    with pytest.raises(ValueError):
        s.set(nothing=1)
    with pytest.raises(TypeError):
        s.set(with_mean="yes")
    with pytest.raises(ValueError):
        O.Bucketizer(splits_array=[[1.0, 1.0, 2.0]])


def test_binarizer(spark):
    df = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0])), (2, Vectors.dense([2.0, 1.0]))], ["a", "v"])
    out = O.Binarizer(input_cols=["a", "v"], output_cols=["oa", "ov"], thresholds=[1.0, 1.5]).transform(df)
    assert rows(out, "oa", "ov") == [(0.0, Vectors.dense([0.0, 1.0])), (1.0, Vectors.dense([1.0, 0.0]))]


def test_bucketizer(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (2.0,), (math.nan,), (5.0,), (-math.inf,)], ["x"])
    b = O.Bucketizer(input_cols=["x"], output_cols=["b"], splits_array=[[-0.5, 0.0, 0.5, 2.0]], handle_invalid="keep")
    assert rows(b.transform(df), "b") == [(0.0,), (1.0,), (2.0,), (3.0,), (3.0,), (3.0,)]
    assert b.set(handle_invalid="skip").transform(df).count() == 3
    with pytest.raises(Exception, match="splits"):
        b.set(handle_invalid="error").transform(df).collect()


def test_vector_assembler(spark):
    df = spark.createDataFrame([(1.0, [2.0, 3.0]), (None, [1.0, 1.0]), (1.0, None)], "a double, v array<double>")
    a = O.VectorAssembler(input_cols=["a", "v"], input_sizes=[1, 2], handle_invalid="keep")
    got = [r.output for r in a.transform(df).collect()]
    assert near(got[0], [1.0, 2.0, 3.0]) and near(got[1], [math.nan, 1.0, 1.0]) and near(got[2], [1.0, math.nan, math.nan])
    assert a.set(handle_invalid="skip").transform(df).count() == 1
    with pytest.raises(Exception, match="null"):
        a.set(handle_invalid="error").transform(df).collect()


def test_slicer_product_interaction(spark):
    df = spark.createDataFrame([([2.1, 3.1, 2.3],)], "v array<double>")
    assert rows(O.VectorSlicer(input_col="v", indices=[2, 0]).transform(df), "output") == [([2.3, 2.1],)]
    with pytest.raises(Exception, match="beyond"):
        O.VectorSlicer(input_col="v", indices=[3]).transform(df).collect()
    assert near(O.ElementwiseProduct(input_col="v", scaling_vec=[1.0, 2.0, 0.0]).transform(df).first().output, [2.1, 6.2, 0.0])
    df = spark.createDataFrame([(2.0, [1.0, 3.0], [1.0, 10.0])], "a double, b array<double>, c array<double>")
    assert near(O.Interaction(input_cols=["a", "b", "c"]).transform(df).first().output, [2.0, 20.0, 6.0, 60.0])


def test_polynomial_normalizer_dct(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "input array<double>")
    assert near(O.PolynomialExpansion().transform(df).first().output, [1.0, 1.0, 2.0, 2.0, 4.0, 3.0, 3.0, 6.0, 9.0])
    assert near(O.Normalizer(p=1.5).transform(spark.createDataFrame([([2.1, 3.1, 2.3, 3.4, 5.3, 5.1],)], "input array<double>")).first().output, [0.17386300895299714, 0.25665491797823387, 0.19042139075804446, 0.28149249068580483, 0.43879711783375464, 0.42223873602870726])
    zero = spark.createDataFrame([([0.0, 0.0],)], "input array<double>")
    assert all(math.isnan(x) for x in O.Normalizer().transform(zero).first().output)
    four = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0],)], "input array<double>")
    assert near(O.DCT().transform(four).first().output, [2.0, 0.0, 0.0, 0.0])
    back = O.DCT(inverse=True, input_col="output", output_col="again").transform(O.DCT().transform(four))
    assert near(back.first().again, [1.0, 1.0, 1.0, 1.0])


def test_tokens(spark):
    df = spark.createDataFrame([("Test for tokenization.",), ("Te,st. punct",), ("a  b  ",), ("",), (None,)], "input string")
    assert [r.output for r in O.Tokenizer().transform(df).collect()] == [["test", "for", "tokenization."], ["te,st.", "punct"], ["a", "", "b"], [""], None]
    got = O.RegexTokenizer(pattern=r"\w+|\p{Punct}", gaps=False, min_token_length=3).transform(df).limit(2).collect()
    assert [r.output for r in got] == [["test", "for", "tokenization"], ["punct"]]
    assert O.RegexTokenizer(to_lowercase=False).transform(df).first().output == ["Test", "for", "tokenization."]


def test_ngram_stopwords(spark):
    df = spark.createDataFrame([([],), (["a", "b", "c"],), (["a"],)], "input array<string>")
    assert [r.output for r in O.NGram().transform(df).collect()] == [[], ["a b", "b c"], []]
    df = spark.createDataFrame([(["I", "saw", "the", "red", "balloon", None],)], "input array<string>")
    s = O.StopWordsRemover(input_cols=["input"], output_cols=["output"])
    assert s.transform(df).first().output == ["saw", "red", "balloon", None]
    assert s.set(case_sensitive=True).transform(df).first().output == ["I", "saw", "red", "balloon", None]
    assert len(O.StopWordsRemover.load_default_stop_words("turkish")) > 10


def test_hashing(spark):
    df = spark.createDataFrame([(["HashingTFTest", "Hashing", "Term", "Frequency", "Test"],), (["HashingTFTest", "Hashing", "Hashing", "Test", "Test"],)], "input array<string>")
    got = [r.output for r in O.HashingTF().transform(df).collect()]
    assert got[0].indices == [67564, 89917, 113827, 131486, 228971] and got[0].size == 262144
    assert dict(zip(got[1].indices, got[1]["values"], strict=True)) == {67564: 1.0, 131486: 1.0, 228971: 1.0} or sorted(got[1]["values"]) == [1.0, 2.0, 2.0]
    df = spark.createDataFrame([("a", 1.0, True), ("c", 1.0, False)], "f0 string, f1 double, f2 boolean")
    got = O.FeatureHasher(input_cols=["f0", "f1", "f2"], categorical_cols=["f0", "f2"], num_features=1000).transform(df).collect()
    assert got[0].output.indices == [607, 635, 913] and got[0].output["values"] == [1.0, 1.0, 1.0]


def test_scalers(spark):
    df = spark.createDataFrame([([-2.5, 9.0, 1.0],), ([1.4, -5.0, 1.0],), ([2.0, -1.0, -2.0],)], "input array<double>")
    m = O.StandardScaler().fit(df)
    assert near(m.data["mean"], [0.3, 1.0, 0.0]) and near(m.data["std"], [2.4433583, 7.2111026, 1.7320508])
    assert near(m.transform(df).first().output, [-1.0231819, 1.2480754, 0.5773502])
    assert near(O.StandardScaler(with_mean=True).fit(df).transform(df).first().output, [-1.1459637, 1.1094004, 0.5773502])
    df = spark.createDataFrame([([0.0, 3.0],), ([2.1, 0.0],), ([4.1, 5.1],), ([6.1, 8.1],), ([200.0, 400.0],)], "input array<double>")
    test = spark.createDataFrame([([150.0, 90.0],), ([50.0, 40.0],), ([100.0, 50.0],)], "input array<double>")
    assert near([r.output for r in O.MinMaxScaler().fit(df).transform(test).collect()], [[0.75, 0.225], [0.25, 0.1], [0.5, 0.125]])
    df = spark.createDataFrame([([float(i), -10.0 * i],) for i in range(9)], "input array<double>")
    m = O.RobustScaler().fit(df)
    assert near(m.data["medians"], [4.0, -40.0]) and near(m.data["ranges"], [4.0, 40.0])
    df = spark.createDataFrame([([0.0, 0.0, 5.0],), ([-8.0, 2.0, 1.0],)], "input array<double>")
    assert near(O.MaxAbsScaler().fit(df).transform(df).collect()[1].output, [-1.0, 1.0, 0.2])
    with pytest.raises(ValueError, match="empty"):
        O.StandardScaler().fit(df.limit(0))


def test_wide_vectors(spark):
    df = spark.range(20).select(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i * F.col("id")).cast("double")).alias("input"))
    m = O.StandardScaler(with_mean=True).fit(df)
    assert len(m.data["mean"]) == 200 and near(m.data["mean"][199], 199 * 9.5)
    assert near(m.transform(df).first().output[0], 0.0)


def test_sparse_like_dense(spark):
    rows = [[0.0, 2.0, -1.0, 0.0], [3.0, 2.0, 0.0, 0.0], [0.0, 4.0, -5.0, 0.0], [1.0, 2.0, 0.0, 0.0]]
    dense = spark.createDataFrame([(x,) for x in rows], "input array<double>").coalesce(1)
    sparse = spark.createDataFrame([((4, [i for i, v in enumerate(x) if v], [v for v in x if v]),) for x in rows], "input struct<size int, indices array<int>, values array<double>>").coalesce(1)
    for made in (O.StandardScaler(), O.StandardScaler(with_mean=True), O.MinMaxScaler(), O.MaxAbsScaler(), O.VarianceThresholdSelector(variance_threshold=1.0), O.IDF()):
        a, b = made.fit(dense), made.fit(sparse)
        want = [r.output for r in a.transform(dense).collect()]
        got = [r.output for r in b.transform(sparse).collect()]
        got = [[dict(zip(g.indices, g["values"], strict=True)).get(k, 0.0) for k in range(g.size)] if hasattr(g, "indices") else g for g in got]
        assert near(got, want), type(made).__name__
    for made in (O.Binarizer(input_cols=["input"], output_cols=["output"], thresholds=[1.5]), O.Normalizer(), O.ElementwiseProduct(scaling_vec=[1.0, 2.0, 3.0, 4.0])):
        got = [r.output for r in made.transform(sparse).collect()]
        got = [[dict(zip(g.indices, g["values"], strict=True)).get(k, 0.0) for k in range(g.size)] for g in got]
        assert near(got, [r.output for r in made.transform(dense).collect()]), type(made).__name__


def test_imputer(spark):
    df = spark.createDataFrame([(math.nan, 9.0), (1.0, 9.0), (1.5, 9.0), (2.5, math.nan), (5.0, 5.0), (5.0, 4.0)], "f1 double, f2 double")
    im = O.Imputer(input_cols=["f1", "f2"], output_cols=["o1", "o2"])
    assert near(list(im.fit(df).data["surrogates"].values()), [3.0, 7.2])
    assert near(list(im.set(strategy="median").fit(df).data["surrogates"].values()), [2.5, 9.0])
    m = im.set(strategy="most_frequent").fit(df)
    assert near(list(m.data["surrogates"].values()), [5.0, 9.0])
    assert rows(m.transform(df), "o1", "o2")[0] == (5.0, 9.0)


def test_selectors_idf(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 3.0],), ([0.0, 1.0, 2.0, 9.0],), ([0.0, 1.0, 4.0, 1.0],)], "input array<double>")
    assert O.VarianceThresholdSelector(variance_threshold=2.0).fit(df).data["indices"] == [2, 3]
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 2.0],), ([0.0, 1.0, 2.0, 3.0],), ([0.0, 1.0, 0.0, 0.0],)], "input array<double>")
    m = O.IDF().fit(df)
    assert near(m.data["idf"], [1.3862943, 0.0, 0.6931472, 0.2876821]) and m.data["numDocs"] == 3


def test_indexers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 0.0), ("d", 2.0), ("a", 2.0), ("b", -1.0)], "s string, x double")
    s = O.StringIndexer(input_cols=["s", "x"], output_cols=["si", "xi"], string_order_type="frequencyDesc")
    m = s.fit(df)
    assert m.data["stringArrays"] == [["b", "a", "c", "d"], ["2.0", "1.0", "-1.0", "0.0"]]
    test = spark.createDataFrame([("a", 2.0), ("e", 5.0), (None, None)], "s string, x double")
    assert rows(m.set(handle_invalid="keep").transform(test), "si", "xi") == [(1.0, 0.0), (4.0, 4.0), (4.0, 4.0)]
    assert m.set(handle_invalid="skip").transform(test).count() == 1
    with pytest.raises(Exception, match="not in the model"):
        m.set(handle_invalid="error").transform(test).collect()
    assert s.set(max_index_num=3).fit(df).data["stringArrays"][0] == ["b", "a"]
    back = O.IndexToStringModel(input_cols=["si"], output_cols=["t"]).with_data(stringArrays=[["b", "a", "c", "d"]])
    assert rows(back.transform(spark.createDataFrame([(0.0,), (3.0,)], "si double")), "t") == [("b",), ("d",)]
    m.save(spark, str(tmp_path / "m"))
    assert O.StringIndexerModel.load(spark, str(tmp_path / "m")).data == m.data


def test_one_hot_vector_indexer(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (0.0,)], "input double")
    e = O.OneHotEncoder(input_cols=["input"], output_cols=["o"])
    got = [r.o for r in e.fit(df).transform(df).collect()]
    assert [(r.size, r.indices, r["values"]) for r in got] == [(2, [0], [1.0]), (2, [1], [1.0]), (2, [], []), (2, [0], [1.0])]
    with pytest.raises(ValueError):
        e.fit(spark.createDataFrame([(0.5,)], "input double"))
    df = spark.createDataFrame([([1.0, 1.0],), ([2.0, -1.0],), ([3.0, 1.0],), ([4.0, 0.0],), ([5.0, 0.0],)], "input array<double>")
    m = O.VectorIndexer(max_categories=3, handle_invalid="keep").fit(df)
    assert m.data["categoryMaps"] == {1: {0.0: 0, -1.0: 1, 1.0: 2}}
    assert near(m.transform(spark.createDataFrame([([0.0, 2.0],), ([1.0, 1.0],)], "input array<double>")).collect()[0].output, [0.0, 3.0])


def test_count_vectorizer(spark):
    df = spark.createDataFrame([(["a", "c", "b", "c"],), (["c", "d", "e"],), (["a", "b", "c"],), (["e", "f"],), (["a", "c", "a"],)], "input array<string>")
    m = O.CountVectorizer().fit(df)
    assert m.data["vocabulary"] == ["c", "a", "b", "e", "d", "f"]
    got = m.transform(df).first().output
    assert (got.size, got.indices, got["values"]) == (6, [0, 1, 2], [2.0, 1.0, 1.0])
    assert m.set(binary=True).transform(df).first().output["values"] == [1.0, 1.0, 1.0]
    got = {tuple(r.input): (r.output.indices, r.output["values"]) for r in m.set(binary=False).transform(df).collect()}
    assert got[("a", "c", "b", "c")] == ([0, 1, 2], [2.0, 1.0, 1.0]) and got[("e", "f")] == ([3, 5], [1.0, 1.0])
    assert m.set(min_tf=2.0).transform(df).first().output.indices == [0]
    odd = spark.createDataFrame([(None,), ([],), (["zz", None],)], "input array<string>")
    assert [r.output and r.output.indices for r in m.transform(odd).collect()] == [None, [], []]


@pytest.mark.parametrize(("strategy", "first", "third"), [("uniform", [0, 0, 0, 1, 1, 2, 2], [0, 1, 2, 2, 2, 2, 2]), ("quantile", [0, 0, 0, 1, 2, 2, 2], [0, 0, 1, 1, 1, 1, 1]), ("kmeans", [0, 0, 0, 1, 1, 2, 2], [0, 1, 2, 2, 2, 2, 2])])
def test_kbins(spark, strategy, first, third):
    train = spark.createDataFrame([([float(x), 10.0, float(z)],) for x, z in zip([1, 1, 1, 4, 5, 6, 7, 10, 13], [0] * 8 + [3], strict=True)], "input array<double>")
    test = spark.createDataFrame([([x, 1.0, float(k)],) for k, x in enumerate([-1.0, 1.0, 1.5, 5.0, 7.25, 13.0, 15.0])], "input array<double>")
    got = [r.output for r in O.KBinsDiscretizer(strategy=strategy, num_bins=3).fit(train).transform(test).collect()]
    assert [g[0] for g in got] == first and [g[1] for g in got] == [0] * 7 and [g[2] for g in got] == third


def test_minhash(spark):
    made = [(0, [0, 1, 2]), (1, [2, 3, 4]), (2, [0, 2, 4])]
    df = spark.createDataFrame([(i, (6, at, [1.0] * 3)) for i, at in made], "id int, input struct<size int, indices array<int>, values array<double>>")
    lsh = O.MinHashLSH(seed=2022, num_hash_tables=5, num_hash_functions_per_table=1)
    m = lsh.fit(df)
    near_ = m.approx_nearest_neighbors(df, [1, 3], 2).collect()
    assert all(abs(r.distCol - 0.75) < 1e-9 for r in near_)
    pairs = {(r.id_a, r.id_b): r.distCol for r in m.approx_similarity_join(df, df, 0.6, "id").collect()}
    assert all(d <= 0.6 for d in pairs.values()) and pairs[0, 0] == 0.0
    assert [len(r.output) for r in m.transform(df).collect()] == [5, 5, 5]


def test_sql_and_split(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (2, 2.0, 5.0)], "id int, v1 double, v2 double")
    assert rows(O.SQLTransformer(statement="SELECT *, (v1 + v2) AS v3 FROM __THIS__").transform(df), "v3") == [(4.0,), (7.0,)]
    with pytest.raises(ValueError):
        O.SQLTransformer(statement="SELECT 1")
    a, b = O.RandomSplitter(weights=[4.0, 6.0], seed=1).transform(spark.range(10000))
    assert a.count() + b.count() == 10000 and abs(a.count() - 4000) < 300 and a.intersect(b).count() == 0
