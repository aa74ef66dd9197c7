"""The registered queries: every stage over the tables of a folder, and the same in DuckDB SQL where SQL can say it.

Numbers are rounded in both, and ``+ 0.0`` makes a negative zero a zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..core.pipeline import Pipeline
from ..streaming import windows as W
from ..streaming.online import OnlineKMeans, OnlineLogisticRegression, OnlineStandardScaler
from . import dataflow as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0


def elements(c: str, names: list[str], n: int = 6) -> list[Column]:
    return [r(F.get(F.col(c), k), n).alias(x) for k, x in enumerate(names)]


KEY = ["l_orderkey", "l_linenumber"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def numbers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").withColumn("v", F.array(*NUMBERS))


# Rows to rows.


@query("select l_orderkey, l_linenumber, case when l_quantity > 25 then 1.0 else 0.0 end::double as big, case when l_discount > 0.05 then 1.0 else 0.0 end::double as cheap from lineitem")
def binarizer(spark: SparkSession, d: str) -> DataFrame:
    return O.Binarizer(input_cols=["l_quantity", "l_discount"], output_cols=["big", "cheap"], thresholds=[25.0, 0.05]).transform(load(spark, d, "lineitem")).select(*KEY, "big", "cheap")


@query("select l_orderkey, l_linenumber, case when l_quantity is null or l_quantity < 5 or l_quantity > 40 then 3 when l_quantity < 10 then 0 when l_quantity < 25 then 1 else 2 end::double as bucket from lineitem")
def bucketizer(spark: SparkSession, d: str) -> DataFrame:
    made = O.Bucketizer(input_cols=["l_quantity"], output_cols=["bucket"], splits_array=[[5.0, 10.0, 25.0, 40.0]], handle_invalid="keep")
    return made.transform(load(spark, d, "lineitem")).select(*KEY, "bucket")


@query("select l_orderkey, l_linenumber, l_quantity as a, l_discount as b, l_tax as c from lineitem where l_quantity is not null and l_discount is not null and l_tax is not null")
def vector_assembler(spark: SparkSession, d: str) -> DataFrame:
    made = O.VectorAssembler(input_cols=["l_quantity", "pair"], input_sizes=[1, 2], handle_invalid="skip")
    df = load(spark, d, "lineitem").withColumn("pair", F.array("l_discount", "l_tax"))
    return made.transform(df).select(*KEY, *[F.get("output", k).alias(n) for k, n in enumerate("abc")])


@query("select vec_id, embedding[4]::double as a, embedding[2]::double as b from embeddings")
def vector_slicer(spark: SparkSession, d: str) -> DataFrame:
    return O.VectorSlicer(input_col="embedding", indices=[3, 1]).transform(load(spark, d, "embeddings")).select("vec_id", F.get("output", 0).alias("a"), F.get("output", 1).alias("b"))


@query("select l_orderkey, l_linenumber, round(l_quantity * 2, 6) + 0.0 as a, round(l_extendedprice * 0.001, 6) + 0.0 as b, 0.0::double as c, round(l_tax * -1, 6) + 0.0 as d from lineitem")
def elementwise_product(spark: SparkSession, d: str) -> DataFrame:
    return O.ElementwiseProduct(input_col="v", scaling_vec=[2.0, 0.001, 0.0, -1.0]).transform(numbers(spark, d)).select(*KEY, *elements("output", list("abcd")))


@query("select l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) + 0.0 as a, round(l_quantity * l_tax, 6) + 0.0 as b from lineitem")
def interaction(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("pair", F.array("l_discount", "l_tax"))
    return O.Interaction(input_cols=["l_quantity", "pair"]).transform(df).select(*KEY, *elements("output", ["a", "b"]))


@query("select l_orderkey, l_linenumber, l_discount as a, round(l_discount * l_discount, 6) + 0.0 as b, l_tax as c, round(l_discount * l_tax, 6) + 0.0 as d, round(l_tax * l_tax, 6) + 0.0 as e from lineitem")
def polynomial_expansion(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("input", F.array("l_discount", "l_tax"))
    return O.PolynomialExpansion(degree=2).transform(df).select(*KEY, *elements("output", list("abcde")))


@query("with n as (select vec_id, embedding e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) z from embeddings) select vec_id, round(e[1]::double / z, 6) + 0.0 as a, round(e[64]::double / z, 6) + 0.0 as b from n")
def normalizer(spark: SparkSession, d: str) -> DataFrame:
    return O.Normalizer(input_col="embedding").transform(load(spark, d, "embeddings")).select("vec_id", r(F.get("output", 0)).alias("a"), r(F.get("output", 63)).alias("b"))


@query("with t as (select vec_id, len(embedding) n, list_transform(embedding, lambda x, i: x::double * cos(pi() * (i - 0.5) * 1 / len(embedding))) c1, list_transform(embedding, lambda x, i: x::double * cos(pi() * (i - 0.5) * 2 / len(embedding))) c2, list_transform(embedding, lambda x: x::double) c0 from embeddings) select vec_id, round(list_sum(c0) / sqrt(n), 6) + 0.0 as a, round(list_sum(c1) * sqrt(2.0 / n), 6) + 0.0 as b, round(list_sum(c2) * sqrt(2.0 / n), 6) + 0.0 as c from t")
def dct(spark: SparkSession, d: str) -> DataFrame:
    return O.DCT(input_col="embedding").transform(load(spark, d, "embeddings")).select("vec_id", *elements("output", list("abc")))


@query("select l_returnflag, round(sum(l_quantity), 2) + 0.0 as quantity, count(*) as n, round(avg(abs(l_discount - l_tax)), 6) + 0.0 as gap from lineitem group by l_returnflag")
def sql_transformer(spark: SparkSession, d: str) -> DataFrame:
    made = O.SQLTransformer(statement="SELECT l_returnflag, ROUND(SUM(l_quantity), 2) + 0.0D AS quantity, COUNT(*) AS n, ROUND(AVG(ABS(l_discount - l_tax)), 6) + 0.0D AS gap FROM __THIS__ GROUP BY l_returnflag")
    return made.transform(load(spark, d, "lineitem"))


@query("select l_orderkey, l_linenumber, l_quantity as back from lineitem")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import array_to_vector, vector_to_array

    df = numbers(spark, d).withColumn("u", array_to_vector("v"))
    return df.select(*KEY, F.get(vector_to_array("u"), 0).alias("back"))


@query()
def random_splitter(spark: SparkSession, d: str) -> DataFrame:
    parts = O.RandomSplitter(weights=[3.0, 1.0], seed=7).transform(load(spark, d, "lineitem").select(*KEY))
    return fold(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])


# Text.

TOKENS_SQL = r"case when text = '' then [''] when regexp_replace(lower(text), '[ \t\n\f\r]+$', '') = '' then [] else regexp_split_to_array(regexp_replace(lower(text), '[ \t\n\f\r]+$', ''), '[ \t\n\f\r]') end"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return O.Tokenizer(input_col="text", output_col="tokens").transform(load(spark, d, "documents").select("doc_id", "text"))


@query(f"with t as (select doc_id, {TOKENS_SQL} w from documents) select doc_id, len(w) as n, md5(array_to_string(w, '|')) as hash from t")
def tokenizer(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", "|")).alias("hash"))


@query(r"with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '\w+'), lambda x: length(x) >= 4) w from documents) select doc_id, len(w) as n, md5(array_to_string(w, '|')) as hash from t")
def regex_tokenizer(spark: SparkSession, d: str) -> DataFrame:
    made = O.RegexTokenizer(input_col="text", output_col="w", pattern=r"\w+", gaps=False, min_token_length=4).transform(load(spark, d, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|")).alias("hash"))


@query(f"with t as (select doc_id, {TOKENS_SQL} w from documents), g as (select doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) g from t) select doc_id, len(g) as n, md5(array_to_string(g, '|')) as hash from g")
def ngram(spark: SparkSession, d: str) -> DataFrame:
    made = O.NGram(n=2, input_col="tokens", output_col="g").transform(tokens(spark, d))
    return made.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("hash"))


@query(f"with t as (select doc_id, {TOKENS_SQL} w from documents), k as (select doc_id, list_filter(w, lambda x: x not in ('the', 'of', 'and', 'to')) k from t) select doc_id, len(k) as n, md5(array_to_string(k, '|')) as hash from k")
def stop_words_remover(spark: SparkSession, d: str) -> DataFrame:
    made = O.StopWordsRemover(input_cols=["tokens"], output_cols=["k"], stop_words=["the", "of", "and", "to"]).transform(tokens(spark, d))
    return made.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|")).alias("hash"))


@query()
def hashing_tf(spark: SparkSession, d: str) -> DataFrame:
    made = O.HashingTF(input_col="tokens", output_col="tf").transform(tokens(spark, d))
    return made.select("doc_id", F.size("tf.indices").alias("kinds"), F.aggregate("tf.values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query()
def feature_hasher(spark: SparkSession, d: str) -> DataFrame:
    made = O.FeatureHasher(input_cols=["o_orderstatus", "o_orderpriority", "o_totalprice"], num_features=1000).transform(load(spark, d, "orders"))
    return made.select("o_orderkey", F.size("output.indices").alias("kinds"), r(F.aggregate("output.values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


VOCABULARY_SQL = f"tok as (select doc_id, unnest({TOKENS_SQL}) t from documents), voc as (select t, row_number() over (order by count(distinct doc_id) desc, t) - 1 as i from tok group by t having count(distinct doc_id) >= 20 qualify i < 500), cnt as (select doc_id, i, count(*) n from tok join voc using (t) group by all)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    df = tokens(spark, d)
    return O.CountVectorizer(input_col="tokens", output_col="tf", vocabulary_size=500, min_df=20.0).fit(df).transform(df)


@query(f"with {VOCABULARY_SQL} select doc_id, i::int as term, n::double as n from cnt")
def count_vectorizer(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).select("doc_id", F.explode(F.arrays_zip("tf.indices", "tf.values")).alias("e")).select("doc_id", F.col("e.indices").alias("term"), F.col("e.values").alias("n"))


@query(f"with {VOCABULARY_SQL}, df as (select i, count(*) df from cnt group by i) select doc_id, i::int as term, round(n * ln(((select count(*) from documents) + 1) / (df + 1)), 6) + 0.0 as weight from cnt join df using (i)")
def idf(spark: SparkSession, d: str) -> DataFrame:
    df = counts(spark, d)
    made = O.IDF(input_col="tf", output_col="w").fit(df).transform(df)
    return made.select("doc_id", F.explode(F.arrays_zip("w.indices", "w.values")).alias("e")).select("doc_id", F.col("e.indices").alias("term"), r("e.values").alias("weight"))


# Scalers.


@query("with s as (select avg(l_quantity) ma, stddev_samp(l_quantity) sa, avg(l_extendedprice) mb, stddev_samp(l_extendedprice) sb from lineitem) select l_orderkey, l_linenumber, round((l_quantity - ma) / sa, 6) + 0.0 as a, round((l_extendedprice - mb) / sb, 6) + 0.0 as b from lineitem, s")
def standard_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = numbers(spark, d)
    return O.StandardScaler(input_col="v", with_mean=True).fit(df).transform(df).select(*KEY, *elements("output", ["a", "b"]))


@query("with s as (select min(l_quantity) a0, max(l_quantity) a1, min(l_extendedprice) b0, max(l_extendedprice) b1 from lineitem) select l_orderkey, l_linenumber, round((l_quantity - a0) / (a1 - a0) * 3 - 1, 6) + 0.0 as a, round((l_extendedprice - b0) / (b1 - b0) * 3 - 1, 6) + 0.0 as b from lineitem, s")
def min_max_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = numbers(spark, d)
    return O.MinMaxScaler(input_col="v", min=-1.0, max=2.0).fit(df).transform(df).select(*KEY, *elements("output", ["a", "b"]))


@query("with s as (select max(abs(l_quantity)) a, max(abs(l_extendedprice)) b from lineitem) select l_orderkey, l_linenumber, round(l_quantity / s.a, 6) + 0.0 as a, round(l_extendedprice / s.b, 6) + 0.0 as b from lineitem, s")
def max_abs_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = numbers(spark, d)
    return O.MaxAbsScaler(input_col="v").fit(df).transform(df).select(*KEY, *elements("output", ["a", "b"]))


@query("with s as (select quantile_disc(l_quantity, [0.25, 0.5, 0.75]) a, quantile_disc(l_extendedprice, [0.25, 0.5, 0.75]) b from lineitem) select l_orderkey, l_linenumber, round((l_quantity - a[2]) / (a[3] - a[1]), 6) + 0.0 as x, round((l_extendedprice - b[2]) / (b[3] - b[1]), 6) + 0.0 as y from lineitem, s")
def robust_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = numbers(spark, d)
    return O.RobustScaler(input_col="v", with_centering=True, relative_error=1e-7).fit(df).transform(df).select(*KEY, *elements("output", ["x", "y"]))


def holes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("double")).alias("b"))


def _imputed(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    df = holes(spark, d)
    made = O.Imputer(input_cols=["a", "b"], output_cols=["x", "y"], strategy=strategy, relative_error=1e-7).fit(df).transform(df)
    return made.select("c_custkey", r("x").alias("x"), r("y").alias("y"))


def _impute_sql(f: str) -> str:
    return f"with h as (select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end a, case when c_custkey % 5 <> 0 then c_nationkey::double end b from customer), {f} select c_custkey, round(coalesce(a, fa), 6) + 0.0 as x, round(coalesce(b, fb), 6) + 0.0 as y from h, f"


@query(_impute_sql("f as (select avg(a) fa, avg(b) fb from h)"))
def imputer_mean(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d, "mean")


@query(_impute_sql("f as (select quantile_disc(a, 0.5) fa, quantile_disc(b, 0.5) fb from h)"))
def imputer_median(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d, "median")


@query(_impute_sql("f as (select (select a from h where a is not null group by a order by count(*) desc, a limit 1) fa, (select b from h where b is not null group by b order by count(*) desc, b limit 1) fb)"))
def imputer_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d, "most_frequent")


@query("with e as (select unnest(range(0, 64)) i), v as (select i, var_pop(embedding[i + 1]::double) x from embeddings, e group by i), k as (select list(i order by i) ix from v where x > 0.0155) select vec_id, len(ix) as n, round(list_sum(list_transform(ix, lambda i: embedding[i + 1]::double)), 6) + 0.0 as total from embeddings, k")
def variance_threshold_selector(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings")
    made = O.VarianceThresholdSelector(input_col="embedding", variance_threshold=0.0155).fit(df).transform(df)
    return made.select("vec_id", F.size("output").cast("long").alias("n"), r(F.aggregate("output", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("with s as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) select l_orderkey, l_linenumber, least(floor((l_extendedprice - lo) / ((hi - lo) / 4)), 3)::double as bin from lineitem, s")
def kbins_uniform(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("input", F.array("l_extendedprice"))
    return O.KBinsDiscretizer(strategy="uniform", num_bins=4).fit(df).transform(df).select(*KEY, F.get("output", 0).alias("bin"))


@query("with s as (select o_totalprice x, row_number() over (order by o_totalprice) - 1 k, count(*) over () n from orders), e as (select max(case when k = floor(n / 4) then x end) a, max(case when k = floor(2 * n / 4) then x end) b, max(case when k = floor(3 * n / 4) then x end) c from s) select o_orderkey, case when o_totalprice >= c then 3 when o_totalprice >= b then 2 when o_totalprice >= a then 1 else 0 end::double as bin from orders, e")
def kbins_quantile(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").withColumn("input", F.array("o_totalprice"))
    return O.KBinsDiscretizer(strategy="quantile", num_bins=4).fit(df).transform(df).select("o_orderkey", F.get("output", 0).alias("bin"))


@query()
def kbins_kmeans(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").withColumn("input", F.array("o_totalprice"))
    return O.KBinsDiscretizer(strategy="kmeans", num_bins=4).fit(df).transform(df).select("o_orderkey", F.get("output", 0).alias("bin"))


# Indices.


@query("with s as (select o_orderpriority p, row_number() over (order by count(*) desc, o_orderpriority) - 1 i from orders group by 1), t as (select o_orderstatus p, row_number() over (order by o_orderstatus desc) - 1 i from orders group by 1) select o_orderkey, s.i::double as priority from orders join s on o_orderpriority = s.p")
def string_indexer(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    return O.StringIndexer(input_cols=["o_orderpriority"], output_cols=["priority"], string_order_type="frequencyDesc").fit(df).transform(df).select("o_orderkey", "priority")


@query("select o_orderkey, o_orderpriority as again, o_orderstatus as status from orders")
def index_to_string(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    cols = {"input_cols": ["o_orderpriority", "o_orderstatus"], "output_cols": ["p", "s"]}
    m = O.StringIndexer(string_order_type="alphabetDesc", **cols).fit(df)
    back = O.IndexToStringModel(input_cols=["p", "s"], output_cols=["again", "status"]).set_model_data(m.get_model_data(spark))
    return back.transform(m.transform(df)).select("o_orderkey", "again", "status")


@query("select c_custkey, (select max(c_nationkey) from customer)::int as size, case when c_nationkey < (select max(c_nationkey) from customer) then c_nationkey::int else -1 end as hot from customer")
def one_hot_encoder(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "customer").withColumn("n", F.col("c_nationkey").cast("double"))
    made = O.OneHotEncoder(input_cols=["n"], output_cols=["o"]).fit(df).transform(df)
    return made.select("c_custkey", F.col("o.size").alias("size"), F.coalesce(F.get("o.indices", 0), F.lit(-1)).alias("hot"))


@query("with s as (select l_discount x, row_number() over (order by l_discount <> 0, l_discount) - 1 i from lineitem group by 1) select l_orderkey, l_linenumber, l_extendedprice as price, i::double as discount from lineitem join s on l_discount = x")
def vector_indexer(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("input", F.array("l_extendedprice", "l_discount"))
    return O.VectorIndexer(max_categories=20).fit(df).transform(df).select(*KEY, F.get("output", 0).alias("price"), F.get("output", 1).alias("discount"))


# Tests and metrics.


def flags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.ascii("l_returnflag").cast("double").alias("label"), F.array(F.ascii("l_linestatus").cast("double"), F.col("l_linenumber").cast("double"), "l_discount").alias("features"))


def _chi_sql(i: int, c: str) -> str:
    return f"select {i} as feature, round((sum(n * n / (nv * nl / total)) - max(total)), 4) + 0.0 as statistic, ((count(distinct v) - 1) * (count(distinct l) - 1))::bigint as dof from (select v, l, n, sum(n) over (partition by v)::double nv, sum(n) over (partition by l)::double nl, sum(n) over ()::double total from (select {c} v, l_returnflag l, count(*)::double n from lineitem group by all))"


@query(" union all ".join(_chi_sql(i, c) for i, c in enumerate(("l_linestatus", "l_linenumber", "l_discount"))))
def chi_square_test(spark: SparkSession, d: str) -> DataFrame:
    return O.ChiSqTest(flatten=True).transform(flags(spark, d)).select(F.col("featureIndex").alias("feature"), r("statistic", 4).alias("statistic"), F.col("degreeOfFreedom").alias("dof"))


_LONG = "e as (select unnest(range(0, 64)) i), x as (select i::int i, label, embedding[i + 1]::double x from embeddings, e)"


@query(f"with {_LONG}, g as (select i, label, count(*) n, sum(x) s, sum(x * x) q from x group by all), t as (select i, sum(n) n, sum(s) s, sum(q) q, sum(s * s / n) b, count(*) k from g group by i) select i as feature, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) + 0.0 as f, (n - 1)::bigint as dof from t")
def anova_test(spark: SparkSession, d: str) -> DataFrame:
    return O.ANOVATest(flatten=True, features_col="embedding").transform(load(spark, d, "embeddings")).select(F.col("featureIndex").alias("feature"), r("fValue").alias("f"), F.col("degreeOfFreedom").alias("dof"))


@query(f"with {_LONG}, t as (select i, corr(x, label) r, count(*) n from x group by i) select i as feature, round(r * r / (1 - r * r) * (n - 2), 6) + 0.0 as f, (n - 2)::bigint as dof from t")
def f_value_test(spark: SparkSession, d: str) -> DataFrame:
    return O.FValueTest(flatten=True, features_col="embedding").transform(load(spark, d, "embeddings")).select(F.col("featureIndex").alias("feature"), r("fValue").alias("f"), F.col("degreeOfFreedom").alias("dof"))


@query(f"with {_LONG}, g as (select i, label, count(*) n, sum(x) s, sum(x * x) q from x group by all), t as (select i, sum(n) n, sum(s) s, sum(q) q, sum(s * s / n) b, count(*) k from g group by i), best as (select i from t order by ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) desc, i limit 5), k as (select list(i order by i) ix from best) select vec_id, round(list_sum(list_transform(ix, lambda i: embedding[i + 1]::double)), 6) + 0.0 as total from embeddings, k")
def univariate_feature_selector(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings")
    made = O.UnivariateFeatureSelector(features_col="embedding", feature_type="continuous", label_type="categorical", selection_threshold=5.0).fit(df).transform(df)
    return made.select("vec_id", r(F.aggregate("output", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_STEPS = "s as (select quality::double y, n_chars::double s from labels join documents using (doc_id)), o as (select y, row_number() over (order by s desc, y desc) k from s), c as (select y, k, sum(y) over (order by k) tp, sum(1 - y) over (order by k) fp, sum(y) over () p, sum(1 - y) over () n from o), z as (select *, tp - y tp0, fp - (1 - y) fp0 from c)"


@query(f"with {_STEPS} select round(sum((fp - fp0) / n * (tp + tp0) / p / 2), 6) + 0.0 as roc, round(sum((tp - tp0) / p * (case when tp0 + fp0 > 0 then tp0 / (tp0 + fp0) else 1 end + tp / (tp + fp)) / 2), 6) + 0.0 as pr, round(sum(1 / (p + n) * (tp + tp0) / p / 2), 6) + 0.0 as lorenz, round(max(abs(tp / p - fp / n)), 6) + 0.0 as ks from z")
def binary_classification_evaluator(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    got = O.BinaryClassificationEvaluator(label_col="quality", raw_prediction_col="n_chars", metrics_names=["areaUnderROC", "areaUnderPR", "areaUnderLorenz", "ks"]).transform(df)
    return got.select(*[r(c).alias(n) for c, n in (("areaUnderROC", "roc"), ("areaUnderPR", "pr"), ("areaUnderLorenz", "lorenz"), ("ks", "ks"))])


# Learners.


@query("with f as (select l_orderkey, l_linenumber, ascii(l_returnflag)::double y, [ascii(l_linestatus)::double, l_linenumber::double] x from lineitem), e as (select y, i, x[i + 1] v, count(*)::double n from f, (values (0), (1)) t(i) group by all), k as (select i, count(distinct v) k from e group by i), l as (select y, sum(n) n from e where i = 0 group by y), th as (select l.y, kv.i, kv.v, ln(coalesce(e.n, 0) + 1) - ln(l.n + kv.k) t from l, (select distinct i, v, k from e join k using (i)) kv left join e on e.y = l.y and e.i = kv.i and e.v = kv.v), pr as (select y, ln(n * 2 + 1) - ln((select sum(n) from l) * 2 + (select count(*) from l)) p from l), sc as (select f.x, pr.y, p + a.t + b.t s from (select distinct x from f) f, pr join th a on a.y = pr.y and a.i = 0 join th b on b.y = pr.y and b.i = 1 where a.v = f.x[1] and b.v = f.x[2]), best as (select x, y from sc qualify row_number() over (partition by x order by round(s, 9) desc, y) = 1) select f.x[1] as status, f.x[2] as line, best.y as prediction, count(*) as n from f join best using (x) group by all")
def naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumns({"label": F.ascii("l_returnflag").cast("double"), "features": F.array(F.ascii("l_linestatus").cast("double"), F.col("l_linenumber").cast("double"))})
    scored = O.NaiveBayes().fit(df).transform(df)
    return scored.groupBy(F.get("features", 0).alias("status"), F.get("features", 1).alias("line"), "prediction").agg(F.count("*").alias("n"))


@query("with q as (select vec_id, embedding::double[64] e from embeddings where vec_id < 50), d as (select q.vec_id, t.label, row_number() over (partition by q.vec_id order by round(array_distance(q.e, t.embedding::double[64]), 12), t.vec_id) k from q, embeddings t), v as (select vec_id, label, count(*) n from d where k <= 5 group by all) select vec_id, label::double as prediction from v qualify row_number() over (partition by vec_id order by n desc, label) = 1")
def knn(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").withColumnRenamed("embedding", "features")
    return O.Knn(k=5).fit(df.orderBy("vec_id")).transform(df.where("vec_id < 50")).select("vec_id", "prediction")


@query()
def knn_all(spark: SparkSession, d: str) -> DataFrame:
    """Every row of embeddings; the SQL of ``knn`` asks for the first 50 only."""
    df = load(spark, d, "embeddings").withColumnRenamed("embedding", "features")
    return O.Knn(k=5).fit(df.orderBy("vec_id")).transform(df).select("vec_id", "prediction")


def _kmeans_sql(rounds: int) -> str:
    parts = ["v as (select vec_id, embedding::double[64] e from embeddings)", "c0 as (select vec_id::int k, e c from v where vec_id < 3)"]
    for i in range(rounds):
        parts.append(f"a{i} as (select v.vec_id, e, k from v, c{i} qualify row_number() over (partition by v.vec_id order by round(array_distance(e, c), 12), k) = 1)")
        parts.append(f"m{i} as (select k, i, avg(e[i]) x from a{i}, (select unnest(range(1, 65)) i) group by all)")
        parts.append(f"c{i + 1} as (select k, list(x order by i)::double[64] c from m{i} group by k)")
    return f"with {', '.join(parts)} select v.vec_id, k as cluster from v, c{rounds} qualify row_number() over (partition by v.vec_id order by round(array_distance(e, c), 12), k) = 1"


@query(_kmeans_sql(3))
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").withColumnRenamed("embedding", "features")
    start = [[float(x) for x in t.features] for t in df.where("vec_id < 3").orderBy("vec_id").collect()]
    return O.KMeans(k=3, max_iter=3, initial_centroids=start).fit(df).transform(df).select("vec_id", F.col("prediction").alias("cluster"))


def trained(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").withColumns({"features": F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10), "label": F.when(F.col("l_extendedprice") > 40000, 1.0).otherwise(0.0)})


def _descent_sql(slope: str, label: str, rounds: int, out: str) -> str:
    parts = [f"t as (select l_orderkey, l_linenumber, l_quantity / 50 a, l_discount * 10 b, {label} y from lineitem)", "c0 as (select 0.0::double a, 0.0::double b)"]
    for i in range(rounds):
        parts.append(f"c{i + 1} as (select any_value(c.a) - 0.1 / count(*) * sum(({slope}) * t.a) a, any_value(c.b) - 0.1 / count(*) * sum(({slope}) * t.b) b from (select t.*, c.a ca, c.b cb, t.a * c.a + t.b * c.b dot from t, c{i} c) t, c{i} c)")
    return f"with {', '.join(parts)} select l_orderkey, l_linenumber, {out} from (select t.*, t.a * c.a + t.b * c.b dot from t, c{rounds} c)"


_ALL = 1 << 30


@query(_descent_sql("-(2 * y - 1) / (1 + exp(dot * (2 * y - 1)))", "case when l_extendedprice > 40000 then 1.0 else 0.0 end", 4, "round(1 - 1 / (1 + exp(dot)), 6) + 0.0 as p"))
def logistic_regression(spark: SparkSession, d: str) -> DataFrame:
    df = trained(spark, d)
    return O.LogisticRegression(max_iter=4, global_batch_size=_ALL, tol=0.0).fit(df).transform(df).select(*KEY, r(F.get("raw_prediction", 1)).alias("p"))


@query(_descent_sql("case when 1 - (2 * y - 1) * dot > 0 then -(2 * y - 1) else 0 end", "case when l_extendedprice > 40000 then 1.0 else 0.0 end", 4, "round(dot, 6) + 0.0 as raw"))
def linear_svc(spark: SparkSession, d: str) -> DataFrame:
    df = trained(spark, d)
    return O.LinearSVC(max_iter=4, global_batch_size=_ALL, tol=0.0).fit(df).transform(df).select(*KEY, r(F.get("raw_prediction", 0)).alias("raw"))


@query(_descent_sql("dot - y", "l_extendedprice / 10000", 4, "round(dot, 6) + 0.0 as prediction"))
def linear_regression(spark: SparkSession, d: str) -> DataFrame:
    df = trained(spark, d).withColumn("label", F.col("l_extendedprice") / 10000)
    return O.LinearRegression(max_iter=4, global_batch_size=_ALL, tol=0.0).fit(df).transform(df).select(*KEY, r("prediction").alias("prediction"))


@query("with p as (select distinct user_id u, ascii(event_type) * 1000 + event_id % 200 i from events), n as (select u, count(*) n from p group by u having count(*) between 2 and 1000), k as (select p.u, i, pow(1.0 / (15 + n), 0.3) w from p join n using (u)), met as (select x.u a, y.u b, any_value(x.w) * any_value(y.w) w, list(x.i order by x.i) shared from k x join k y on x.i = y.i and x.u < y.u group by 1, 2 having count(*) > 1), s as (select s1 item, s2 other, sum(w / len(shared)) score from (select w, shared, unnest(shared) s1 from met), lateral (select unnest(shared) s2) where s1 <> s2 group by all) select item::bigint as item, other::bigint as other, round(score, 6) + 0.0 as score from s qualify row_number() over (partition by item order by round(score, 12) desc, other) <= 3")
def swing(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select(F.col("user_id").cast("long").alias("user"), (F.ascii("event_type") * 1000 + F.col("event_id") % 200).cast("long").alias("item"))
    made = O.Swing(min_user_behavior=2, k=3)
    scored = made.scores(df).withColumn("score", F.round("score", 12))
    from pyspark.sql import Window

    top = scored.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "other"))).where("k <= 3")
    return top.select("item", "other", r("score").alias("score"))


@query()
def agglomerative_clustering(spark: SparkSession, d: str) -> DataFrame:
    # every row, in windows of 2000 ids: the matrix of a window is bounded, the last one may be smaller
    df = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.timestamp_millis("vec_id").alias("at"))
    made = O.AgglomerativeClustering(num_clusters=5, linkage="average", windows=W.EventTimeTumblingWindows(2000), time_col="at")
    return made.transform(df)[0].select("vec_id", "prediction")


# Locality-sensitive hashing.


def shingled(spark: SparkSession, d: str) -> DataFrame:
    df = O.Tokenizer(input_col="text", output_col="t").transform(load(spark, d, "benchmark"))
    at = F.array_sort(F.array_distinct(F.transform("t", lambda w: F.pmod(F.length(w) * 31 + F.ascii(w) * 7 + F.ascii(F.substring(w, 3, 1)), F.lit(500)).cast("int"))))
    return df.select("item_id", F.struct(F.lit(500).alias("size"), at.alias("indices"), F.transform(at, lambda i: F.lit(1.0)).alias("values")).alias("input"))


_SHINGLES = r"s as (select item_id, list_sort(list_distinct(list_transform(regexp_split_to_array(regexp_replace(lower(text), '[ \t\n\f\r]+$', ''), '[ \t\n\f\r]'), lambda w: (length(w) * 31 + case when w = '' then 0 else ascii(w) end * 7 + case when length(w) < 3 then 0 else ascii(w[3]) end) % 500))) v from benchmark)"
_COEF = ((1, 1, 7), (2, 1234567, 89), (3, 987654321, 5))


@query(f"with {_SHINGLES}, h as " + "(" + " union all ".join(f"select item_id, {t} t, list_min(list_transform(v, lambda i: ((1 + i::bigint) * {a} + {b}) % 2038074743)) h, v from s" for t, a, b in _COEF) + "), p as (select distinct x.item_id a, y.item_id b, x.v va, y.v vb from h x join h y using (t, h)) select a as item_id_a, b as item_id_b, round(1 - len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))), 6) + 0.0 as dist from p where 1 - len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))) <= 0.7")
def minhash_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    m = O.MinHashLSHModel().with_data(numHashTables=3, numHashFunctionsPerTable=1, randCoefficientA=[a for _, a, _ in _COEF], randCoefficientB=[b for *_, b in _COEF])
    df = shingled(spark, d)
    return m.approx_similarity_join(df, df, 0.7, "item_id", "dist").select("item_id_a", "item_id_b", r("dist").alias("dist"))


@query()
def minhash_nearest_neighbors(spark: SparkSession, d: str) -> DataFrame:
    df = shingled(spark, d)
    m = O.MinHashLSH(num_hash_tables=5, seed=2).fit(df)
    return m.approx_nearest_neighbors(df, list(range(0, 500, 3)), 5, "dist").select("item_id", r("dist").alias("dist"))


# Windows and online learning.


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "ts", F.array("value", F.col("user_id").cast("double")).alias("input"))


@query("with w as (select floor(epoch_us(ts) / 1000 / 86400000)::bigint k, count(*) n, sum(value) s, sum(value * value) q from events group by 1), t as (select k, sum(n) over o n, sum(s) over o s, sum(q) over o q, row_number() over o - 1 v from w window o as (order by k)) select v::bigint as version, ((k + 1) * 86400000 - 1)::bigint as timestamp, round(s / n, 6) + 0.0 as mean, round(sqrt((q - s * s / n) / (n - 1)), 6) + 0.0 as std from t")
def online_standard_scaler(spark: SparkSession, d: str) -> DataFrame:
    made = OnlineStandardScaler(windows=W.EventTimeTumblingWindows(86_400_000), time_col="ts").versions(events(spark, d))
    return made.select("version", "timestamp", r(F.get("mean", 0)).alias("mean"), r(F.get("std", 0)).alias("std"))


@query("with w as (select floor(epoch_us(ts) / 1000 / 86400000)::bigint k from events), v as (select k, (k + 1) * 86400000 - 1 e, row_number() over (order by k) - 1 v from w group by k) select event_id, min(v.v)::bigint as version from events join v on e >= floor(epoch_us(ts) / 1000) - 200000000 group by event_id")
def model_delay(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d)
    s = OnlineStandardScaler(windows=W.EventTimeTumblingWindows(86_400_000), time_col="ts", max_allowed_model_delay_ms=200_000_000)
    return s.fit(df).transform(df).select("event_id", "version")


@query("with o as (select value, row_number() over (order by ts, event_id) - 1 k, count(*) over () n from events) select floor(k / 300)::bigint as window, count(*) as n, round(sum(value), 4) + 0.0 as total from o where floor(k / 300) < floor(n / 300) group by 1")
def count_windows(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events")
    cut = D.batches(df, [F.col("ts"), F.col("event_id")], 300, "window")
    return cut.groupBy("window").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("with t as (select floor(epoch_us(ts) / 1000)::bigint t, value from events), m as (select *, case when t - lag(t) over (order by t) < 600000 then 0 else 1 end f from t), s as (select *, sum(f) over (order by t rows unbounded preceding) - 1 k from m) select k::bigint as window, min(t) as first, max(t) as last, count(*) as n, round(sum(value), 4) + 0.0 as total from s group by k")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    df = W.EventTimeSessionWindows(600_000).assign(load(spark, d, "events"), "ts")
    t = W.millis(F.col("ts"))
    return df.groupBy(F.col("__window").alias("window")).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("select floor(epoch_us(ts) / 1000 / 3600000)::bigint as window, event_type, count(*) as n, round(avg(value), 6) + 0.0 as mean from events group by all")
def event_time_windows(spark: SparkSession, d: str) -> DataFrame:
    df = W.EventTimeTumblingWindows(3_600_000).assign(load(spark, d, "events"), "ts")
    return df.groupBy(F.col("__window").alias("window"), "event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query()
def online_kmeans(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select("event_id", F.array(F.col("value"), F.col("user_id").cast("double")).alias("features"))
    s = OnlineKMeans(k=2, initial_model=([[10.0, 10.0], [50.0, 100.0]], [0.0, 0.0]), global_batch_size=1000, decay_factor=0.8, order_col="event_id")
    return s.fit(df).transform(df).select("event_id", "prediction")


@query()
def online_logistic_regression(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select("event_id", F.array((F.col("value") - 20) / 20, F.lit(1.0)).alias("features"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("label"))
    s = OnlineLogisticRegression(initial_model=[0.0, 0.0], global_batch_size=1000, order_col="event_id", reg=0.01)
    return s.fit(df).transform(df).select("event_id", "prediction", "modelVersion")


# Dataflow and pipelines.


@query("select o_orderkey, (row_number() over (order by o_totalprice, o_orderkey) - 1)::bigint as place from orders")
def global_rank(spark: SparkSession, d: str) -> DataFrame:
    return D.global_rank(load(spark, d, "orders"), [F.col("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("select (select count(*) from orders) as n, round(sum(o_totalprice), 2) + 0.0 as total from orders")
def aggregate(spark: SparkSession, d: str) -> DataFrame:
    n, total = D.aggregate(load(spark, d, "orders").select("o_totalprice"), lambda: (0, 0.0), lambda a, f: (a[0] + len(f), a[1] + float(f["o_totalprice"].sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: a)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), r(F.lit(total), 2).alias("total"))


@query("with c as (select c_nationkey k, count(*) n from customer group by 1), s as (select s_nationkey k, count(*) n from supplier group by 1) select coalesce(c.k, s.k)::bigint as nation, coalesce(c.n, 0)::bigint as customers, coalesce(s.n, 0)::bigint as suppliers from c full join s on c.k = s.k")
def co_group(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = a["c_nationkey"].iloc[0] if len(a) else b["s_nationkey"].iloc[0]
        return pd.DataFrame({"nation": [key], "customers": [len(a)], "suppliers": [len(b)]})

    return D.co_group(load(spark, d, "customer").select("c_nationkey"), load(spark, d, "supplier").select("s_nationkey"), "c_nationkey", "s_nationkey", both, "nation long, customers long, suppliers long")


@query("select max(o_totalprice) as high, min(o_totalprice) as low from orders")
def reduce(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_totalprice").alias("high"), F.col("o_totalprice").alias("low"))
    return D.reduce_all(rows, lambda f: f.iloc[:1].assign(high=f["high"].max(), low=f["low"].min()))


@query("select c_nationkey::bigint as nation, max(c_acctbal) as best from customer group by 1")
def reduce_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("best"))
    return D.reduce_keyed(rows, "nation", lambda f: f.iloc[:1].assign(best=f["best"].max()))


@query("select o_orderkey::bigint as o_orderkey, length(o_orderstatus)::bigint as n from orders")
def map_partition(spark: SparkSession, d: str) -> DataFrame:
    def sizes(frames):
        for f in frames:
            yield f.assign(n=f["o_orderstatus"].str.len())[["o_orderkey", "n"]]

    return D.map_partition(load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus"), sizes, "o_orderkey long, n long")


@query()
def sample(spark: SparkSession, d: str) -> DataFrame:
    return D.sample(load(spark, d, "orders").select("o_orderkey"), 100, 5)


@query()
def pipeline_clusters(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem")
    stages = [
        O.StringIndexer(input_cols=["l_returnflag"], output_cols=["flag"], string_order_type="alphabetAsc"),
        O.VectorAssembler(input_cols=["l_quantity", "l_extendedprice", "l_discount", "flag"], output_col="v"),
        O.StandardScaler(input_col="v", output_col="features", with_mean=True),
        O.KMeans(k=4, max_iter=5, seed=1),
    ]
    made = Pipeline(stages).fit(df).transform(df)
    return made.groupBy("prediction").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("quantity"))
