"""Category indices, vocabularies, one-hot vectors and bins."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import vectors as V
from ..core.params import HasHandleInvalid, HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, Param, gt, gt_eq, in_array
from ..core.stage import Estimator, Model
from .text import counted, joined, slices

#: Up to so many categories a lookup is a literal map; beyond, it is a join with the model's table.
LITERAL = 2000
#: Up to so many rows that table is broadcast, whatever Spark estimates.
BROADCAST = 200_000
#: Distinct values of a column that a model can hold; checked before they reach the driver.
MOST = 5_000_000


def as_string(df: DataFrame, name: str) -> Column:
    """Numbers as their shortest text with a fraction (``2.0``), other values as their text."""
    return F.col(name).cast("double").cast("string") if isinstance(df.schema[name].dataType, T.FloatType | T.DoubleType) else F.col(name).cast("string")


def lookup(df: DataFrame, key: Column, table: dict[str, float], out: str) -> DataFrame:
    """Adds ``table[key]`` as column ``out``, null where there is none."""
    if len(table) <= LITERAL:
        found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("double")
        return df.withColumn(out, found)
    rows = df.sparkSession.createDataFrame(list(table.items()), "__key string, __value double")
    joined = df.withColumn("__at", key).join(F.broadcast(rows) if len(table) <= BROADCAST else rows, F.col("__at") == F.col("__key"), "left")
    return joined.withColumn(out, F.col("__value")).drop("__at", "__key", "__value")


class _StringIndexerParams(HasInputCols, HasOutputCols, HasHandleInvalid):
    pass


class StringIndexerModel(Model, _StringIndexerParams):
    """Strings to indices; a value that is new or null is an error, drops the row, or gets the next index."""

    MODEL_SCHEMA = "stringArrays array<array<string>>"

    def transform(self, df: DataFrame) -> DataFrame:
        arrays = self.need()["stringArrays"]
        for c, o, words in zip(self.get("input_cols"), self.get("output_cols"), arrays, strict=True):
            df = lookup(df, as_string(df, c), {w: float(k) for k, w in enumerate(words)}, o)
            if self.handle_invalid == "skip":
                df = df.where(F.col(o).isNotNull())
            else:
                other = F.lit(float(len(words))) if self.handle_invalid == "keep" else F.raise_error(F.concat(F.lit(f"{c}: not in the model: "), F.coalesce(as_string(df, c), F.lit("null")))).cast("double")
                df = df.withColumn(o, F.coalesce(F.col(o), other))
        return df


class StringIndexer(Estimator, _StringIndexerParams):
    """Orders the distinct values of each column; nulls are not counted, and ties are in alphabetical order."""

    string_order_type = Param("str", "order of the indices", "arbitrary", in_array(("arbitrary", "frequencyDesc", "frequencyAsc", "alphabetDesc", "alphabetAsc")))
    max_index_num = Param("int", "most indices; only with frequencyDesc, which keeps one less", 2**31 - 1, gt(1))

    def fit(self, df: DataFrame) -> StringIndexerModel:
        out, order = [], self.string_order_type
        for c in self.get("input_cols"):
            counts = df.select(as_string(df, c).alias("v")).where("v is not null").groupBy("v").count()
            if order == "frequencyDesc" and self.max_index_num < 2**31 - 1:
                counts = counts.orderBy(F.desc("count"), "v").limit(self.max_index_num - 1)
            counts = counts.persist()
            try:
                if (n := counts.count()) > MOST:
                    raise ValueError(f"{c} has {n} distinct values; a model holds at most {MOST} (see max_index_num)")
                rows = [(r["v"], r["count"]) for r in counts.collect()]  # the model itself: the distinct values
            finally:
                counts.unpersist()
            key = {"frequencyDesc": lambda r: (-r[1], r[0]), "frequencyAsc": lambda r: (r[1], r[0])}.get(order, lambda r: r[0])
            rows.sort(key=key, reverse=order == "alphabetDesc")
            out.append([v for v, _ in rows])
        return self.model(StringIndexerModel(), stringArrays=out)


class IndexToStringModel(Model, HasInputCols, HasOutputCols):
    """Indices back to strings, with the model data of a string indexer; an index out of range is an error."""

    MODEL_SCHEMA = "stringArrays array<array<string>>"

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, o, words in zip(self.get("input_cols"), self.get("output_cols"), self.need()["stringArrays"], strict=True):
            at = F.col(c).cast("int")
            if len(words) > LITERAL:
                rows = df.sparkSession.createDataFrame(list(enumerate(words)), f"__at_{o} int, __word_{o} string")
                df = df.join(F.broadcast(rows) if len(words) <= BROADCAST else rows, at == F.col(f"__at_{o}"), "left").drop(f"__at_{o}")
                found = F.col(f"__word_{o}")
            else:
                found = F.get(F.array(*[F.lit(w) for w in words]), at) if words else F.lit(None).cast("string")
            cols[o] = F.when((at >= 0) & (at < len(words)), found).otherwise(F.raise_error(F.concat(F.lit(f"{c}: no such index: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))))
        return df.withColumns(cols).drop(*[f"__word_{o}" for o in self.get("output_cols")])


class _OneHotParams(HasInputCols, HasOutputCols, HasHandleInvalid):
    drop_last = Param("bool", "whether the last category is all zeros", True)


def _valid_category(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & (x >= 0) & (x == F.floor(x))


class OneHotEncoderModel(Model, _OneHotParams):
    """Indices to sparse vectors with a single 1; the last category is empty with ``drop_last``."""

    MODEL_SCHEMA = "columnIndex int, maxIndex int"

    def get_model_data(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.need()["maxIndex"])), self.MODEL_SCHEMA)

    def set_model_data(self, frame: DataFrame):
        self.data = {"maxIndex": [r.maxIndex for r in frame.orderBy("columnIndex").collect()]}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, o, most in zip(self.get("input_cols"), self.get("output_cols"), self.need()["maxIndex"], strict=True):
            size, x = most + (not self.drop_last), F.col(c).cast("int")
            one = lambda i, v: F.struct(F.lit(size).alias("size"), i.alias("indices"), v.alias("values"))  # noqa: E731, B023
            out = F.when(x < size, one(F.array(x), F.array(F.lit(1.0)))).otherwise(one(F.array().cast("array<int>"), F.array().cast("array<double>")))
            bad = F.raise_error(F.concat(F.lit(f"{c}: no category of the model: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("struct<size int, indices array<int>, values array<double>>")
            cols[o] = F.when(_valid_category(c) & (F.col(c) <= most), out).otherwise(bad)
        return df.withColumns(cols)


class OneHotEncoder(Estimator, _OneHotParams):
    """Finds the greatest index of each column; only handle_invalid=error is supported."""

    def fit(self, df: DataFrame) -> OneHotEncoderModel:
        if self.handle_invalid != "error":
            raise ValueError("only handle_invalid=error is supported")
        names = self.get("input_cols")
        row = df.agg(*[F.max(F.col(c)).alias(f"m{k}") for k, c in enumerate(names)], *[F.sum((~_valid_category(c)).cast("int")).alias(f"b{k}") for k, c in enumerate(names)]).first()
        for k, c in enumerate(names):
            if row[f"m{k}"] is None or row[f"b{k}"]:
                raise ValueError(f"column {c} must hold indices: whole numbers from 0")
        return self.model(OneHotEncoderModel(), maxIndex=[int(row[f"m{k}"]) for k in range(len(names))])


class VectorIndexerModel(Model, HasInputCol, HasOutputCol, HasHandleInvalid):
    """Elements with few values to indices of these, others as they are."""

    MODEL_SCHEMA = "categoryMaps map<int,map<double,int>>"

    def transform(self, df: DataFrame) -> DataFrame:
        maps, v = self.need()["categoryMaps"], V.dense(df, self.input_col)
        unseen = F.lit(False)
        out = v
        for k, values in sorted(maps.items()):
            table = F.create_map(*[F.lit(x) for a, b in values.items() for x in (float(a), float(b))])
            found = F.element_at(table, F.get(v, k) + 0.0)
            unseen = unseen | found.isNull()
            keep = F.coalesce(found, F.lit(float(len(values))))
            out = self._put(out, k, keep)
        if self.handle_invalid == "skip":
            df = df.where(~unseen)
        elif self.handle_invalid == "error":
            out = F.when(unseen, F.raise_error(F.lit(f"{self.input_col}: a value is not in the model")).cast("array<double>")).otherwise(out)
        return df.withColumn(self.output_col, V.like(df, self.input_col, F.when(v.isNotNull(), out)))

    @staticmethod
    def _put(v: Column, k: int, value: Column) -> Column:
        return F.transform(v, lambda x, i: F.when(i == k, value).otherwise(x))


class VectorIndexer(Estimator, HasInputCol, HasOutputCol, HasHandleInvalid):
    """Finds the elements with at most ``max_categories`` values; values are in ascending order, but 0 comes first."""

    max_categories = Param("int", "most values of a categorical element", 20, gt_eq(2))

    def fit(self, df: DataFrame) -> VectorIndexerModel:
        v = V.dense(df, self.input_col)
        V.dimension(df, v)
        most = self.max_categories
        # distinct (place, value) rows are counted before any are gathered, so that a continuous element costs a count
        rows = df.select(F.posexplode(v).alias("i", "x")).select("i", (F.col("x") + 0.0).alias("x")).distinct()
        few = rows.withColumn("n", F.row_number().over(W.partitionBy("i").orderBy("x"))).where(F.col("n") <= most + 1).groupBy("i").agg(F.collect_list("x").alias("xs")).where(F.size("xs") <= most)
        maps = {}
        for i, xs in few.collect():
            order = sorted(xs)
            if 0.0 in order:
                order.remove(0.0)
                order.insert(0, 0.0)
            maps[i] = {x: k for k, x in enumerate(order)}
        return self.model(VectorIndexerModel(), categoryMaps=maps)


class _CountParams(HasInputCol, HasOutputCol):
    min_tf = Param("float", "least count of a term in a document, or share of its tokens below 1", 1.0, gt_eq(0.0))
    binary = Param("bool", "whether every count is 1", False)


class CountVectorizerModel(Model, _CountParams):
    """Counts of the vocabulary's terms as a sparse vector."""

    MODEL_SCHEMA = "vocabulary array<string>"

    def transform(self, df: DataFrame) -> DataFrame:
        words = self.need()["vocabulary"]
        n, binary, min_tf, sc = max(1, len(words)), self.binary, self.min_tf, df.sparkSession.sparkContext
        held = sc.broadcast(words)  # the model: at most vocabulary_size terms

        @F.arrow_udf("struct<size int, indices array<int>, values array<double>>")
        def counts(docs: pa.Array) -> pa.Array:
            return joined([piece(part) for part in slices(docs)])

        def piece(docs: pa.Array) -> pa.Array:
            docs = docs.cast(pa.list_(pa.string()))
            at = pc.index_in(docs.flatten(), value_set=pa.array(held.value, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            least = np.full(len(docs), min_tf) if min_tf >= 1 else pc.list_value_length(docs).fill_null(0).to_numpy(zero_copy_only=False) * min_tf
            return counted(docs, at.astype(np.int64), n, binary, least)

        c = F.col(self.input_col)
        return df.withColumn(self.output_col, F.when(c.isNotNull(), counts(c)))


class CountVectorizer(Estimator, _CountParams):
    """The terms of most documents, within bounds of document frequency; ties are in alphabetical order."""

    vocabulary_size = Param("int", "most terms", 1 << 18, gt(0))
    min_df = Param("float", "least documents of a term, or share of them below 1", 1.0, gt_eq(0.0))
    max_df = Param("float", "most documents of a term, or share of them below 1", float(2**63 - 1), gt_eq(0.0))

    def fit(self, df: DataFrame) -> CountVectorizerModel:
        c = F.col(self.input_col)
        n = df.where(c.isNotNull()).count()
        if not n:
            raise ValueError("the training set is empty")
        low = self.min_df if self.min_df >= 1 else self.min_df * n
        high = self.max_df if self.max_df >= 1 else self.max_df * n
        if high < low:
            raise ValueError("max_df is below min_df")
        counts = df.select(F.explode(F.array_distinct(c)).alias("t")).where("t is not null").groupBy("t").count().where(F.col("count").between(low, high))
        rows = counts.orderBy(F.desc("count"), "t").limit(self.vocabulary_size).collect()
        return self.model(CountVectorizerModel(), vocabulary=[r["t"] for r in rows])


class KBinsDiscretizerModel(Model, HasInputCol, HasOutputCol):
    """Elements to the index of their bin; what is out of range goes to the first or last."""

    MODEL_SCHEMA = "binEdges array<array<double>>"

    def transform(self, df: DataFrame) -> DataFrame:
        v, cols = V.dense(df, self.input_col), []
        for k, edges in enumerate(self.need()["binEdges"]):
            at = F.lit(0.0)
            for b, e in enumerate(edges[1:-1], 1):
                at = F.when(F.get(v, k) >= e, float(b)).otherwise(at)
            cols.append(at)
        return df.withColumn(self.output_col, V.like(df, self.input_col, F.when(v.isNotNull(), F.array(*cols))))


class KBinsDiscretizer(Estimator, HasInputCol, HasOutputCol):
    """Edges of equal width, of equal counts, or midway between one-dimensional k-means centres."""

    strategy = Param("str", "uniform, quantile or kmeans", "quantile", in_array(("uniform", "quantile", "kmeans")))
    num_bins = Param("int", "bins per element", 5, gt_eq(2))
    sub_samples = Param("int", "rows that kmeans looks at, at most; beyond, quantile ranks all rows on the executors", 200000, gt_eq(2))

    def fit(self, df: DataFrame) -> KBinsDiscretizerModel:
        v, bins = V.dense(df, self.input_col), self.num_bins
        if self.strategy == "uniform":
            _, s = V.per_element(df, v, {"low": F.min, "high": F.max})
            edges = [[-math.inf, math.inf] if a == b else [a + (b - a) * k / bins for k in range(bins)] + [b] for a, b in zip(s["low"], s["high"], strict=True)]
            return self.model(KBinsDiscretizerModel(), binEdges=edges)
        V.dimension(df, v)
        n = df.count()
        rows = df.select(v.alias("v"))
        if n > self.sub_samples and self.strategy == "quantile":  # the same edges of all rows, found on the executors
            found = V.order_statistics(df, v, lambda m: [int(k * (m / bins)) + 1 for k in range(bins)] + [1, m])
            return self.model(KBinsDiscretizerModel(), binEdges=[_edges(x[:bins] + x[-1:]) if x[-2] < x[-1] else [-math.inf, math.inf] for x in found])
        if n > self.sub_samples:  # the documented bound; a seeded draw of about so many rows
            rows = rows.sample(False, min(1.0, 1.1 * self.sub_samples / n), 17).limit(self.sub_samples)
        data = np.array([r.v for r in rows.collect()])
        cut = _quantile_edges if self.strategy == "quantile" else _kmeans_edges
        return self.model(KBinsDiscretizerModel(), binEdges=[cut(np.sort(x), bins) for x in data.T])


def _quantile_edges(x: np.ndarray, bins: int) -> list[float]:
    """Edges at equal counts (every value, if there are no more than bins).

    A value that comes up as several edges keeps a bin of its own: up to midway to the next edge, or, if it is the
    greatest, from midway to the one before.
    """
    if x[0] == x[-1]:
        return [-math.inf, math.inf]
    return _edges([x[int(k * (len(x) / bins))] for k in range(bins)] + [x[-1]] if len(x) > bins else x)


def _edges(found: list[float]) -> list[float]:
    kinds, counts = np.unique(found, return_counts=True)
    out: list[float] = []
    for k, (value, n) in enumerate(zip(kinds.tolist(), counts, strict=True)):
        if n > 1 and k == len(kinds) - 1:
            out.append((out[-1] + value) / 2)
        out.append(value)
        if n > 1 and k < len(kinds) - 1:
            out.append((value + float(kinds[k + 1])) / 2)
    return out


def _kmeans_edges(x: np.ndarray, bins: int, rounds: int = 300, tol: float = 1e-4) -> list[float]:
    """Edges midway between centres, which start at equal counts; of equal width if there are no more values than bins."""
    if x[0] == x[-1]:
        return [-math.inf, math.inf]
    if len(np.unique(x)) <= bins:
        return [float(e) for e in np.linspace(x[0], x[-1], bins + 1)]
    centres = np.array([x[int(k * (len(x) / bins))] for k in range(bins)], float)
    sums, squares, last = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)]), math.inf
    for _ in range(rounds):
        at = np.concatenate([[0], np.searchsorted(x, (centres[1:] + centres[:-1]) / 2, side="right"), [len(x)]])
        n, s = np.diff(at), np.diff(sums[at])
        loss = float((np.diff(squares[at]) - 2 * centres * s + n * centres**2).sum()) / len(x)
        centres = np.where(n > 0, s / np.maximum(n, 1), centres)
        if abs(last - loss) <= tol * abs(loss) or loss == 0:
            break
        last = loss
    return [float(x[0]), *((centres[1:] + centres[:-1]) / 2).tolist(), float(x[-1])]


def bin_of(edges: list[float], x: float) -> int:
    """Index of the bin of a number, as the model has it."""
    return min(max(bisect_right(edges, x) - 1, 0), len(edges) - 2)
