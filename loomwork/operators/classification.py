"""Linear classifiers, naive Bayes and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, Param, gt, gt_eq, in_array, not_null
from ..core.stage import Estimator, Model
from .linear import SGDParams, descend, dot_with, hinge_loss, logistic_loss


class LogisticRegressionModel(Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol):
    """Label by the sign of the dot product, raw prediction (1-p, p)."""

    MODEL_SCHEMA = "coefficient array<double>, modelVersion bigint"

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("__dot", dot_with(V.dense(df, self.features_col), self.need()["coefficient"]))
        p = 1 - 1 / (1 + F.exp("__dot"))
        df = df.withColumn(self.prediction_col, F.when(F.col("__dot") >= 0, 1.0).otherwise(0.0))
        return (df.withColumn(self.raw_prediction_col, F.array(1 - p, p)) if self.raw_prediction_col else df).drop("__dot")


class LogisticRegression(Estimator, SGDParams, HasPredictionCol, HasRawPredictionCol):
    """Binomial logistic regression by mini-batch descent, without an intercept."""

    multi_class = Param("str", "auto or binomial; multinomial is not supported", "auto", in_array(("auto", "binomial", "multinomial")))

    def fit(self, df: DataFrame) -> LogisticRegressionModel:
        if self.multi_class == "multinomial":
            raise ValueError("multinomial classification is not supported")
        return self.model(LogisticRegressionModel(), coefficient=descend(self, df, logistic_loss, True), modelVersion=0)


class _SVCParams(HasFeaturesCol, HasPredictionCol, HasRawPredictionCol):
    threshold = Param("float", "dot product from which the label is 1", 0.0, not_null)


class LinearSVCModel(Model, _SVCParams):
    """Label by the dot product against the threshold, raw prediction (dot, -dot)."""

    MODEL_SCHEMA = "coefficient array<double>"

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("__dot", dot_with(V.dense(df, self.features_col), self.need()["coefficient"]))
        df = df.withColumn(self.prediction_col, F.when(F.col("__dot") >= self.threshold, 1.0).otherwise(0.0))
        return (df.withColumn(self.raw_prediction_col, F.array(F.col("__dot"), -F.col("__dot"))) if self.raw_prediction_col else df).drop("__dot")


class LinearSVC(Estimator, SGDParams, _SVCParams):
    """Linear support vector machine by mini-batch descent on the hinge loss, without an intercept."""

    def fit(self, df: DataFrame) -> LinearSVCModel:
        return self.model(LinearSVCModel(), coefficient=descend(self, df, hinge_loss, True))


class _BayesParams(HasFeaturesCol, HasPredictionCol):
    model_type = Param("str", "multinomial", "multinomial", in_array(("multinomial",)))


class NaiveBayesModel(Model, _BayesParams):
    """The label of the greatest sum of log probabilities; ties go to the smallest label, unseen values are an error."""

    MODEL_SCHEMA = "theta array<array<map<double,double>>>, piArray array<double>, labels array<double>"

    def transform(self, df: DataFrame) -> DataFrame:
        d, v = self.need(), V.dense(df, self.features_col)
        score = [F.lit(float(p)) for p in d["piArray"]]
        for j in range(len(d["theta"][0]) if d["theta"] else 0):
            # one lookup per feature gives the log probabilities under all labels
            kinds = sorted(d["theta"][0][j])
            table = F.create_map(*[x for k in kinds for x in (F.lit(float(k)), F.array(*[F.lit(t[j][k]) for t in d["theta"]]))])
            found = F.element_at(table, F.get(v, j) + 0.0)
            df = df.withColumn(f"__t{j}", F.coalesce(found, F.raise_error(F.concat(F.lit(f"feature {j} has a value that is not in the model: "), F.coalesce(F.get(v, j).cast("string"), F.lit("null")))).cast("array<double>")))
            score = [s + F.get(F.col(f"__t{j}"), k) for k, s in enumerate(score)]
        ranked = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-float(y)).alias("y")) for s, y in zip(score, d["labels"], strict=True)]))
        out = df.withColumn(self.prediction_col, -ranked["y"])
        return out.drop(*[c for c in out.columns if c.startswith("__t")])


#: Different (label, feature, value) that a naive Bayes model can hold; checked before they reach the driver.
MOST_VALUES = 2_000_000


class NaiveBayes(Estimator, _BayesParams, HasLabelCol):
    """Categorical naive Bayes from counts of (label, feature, value), combined before the shuffle."""

    smoothing = Param("float", "additive smoothing", 1.0, gt_eq(0.0))

    def fit(self, df: DataFrame) -> NaiveBayesModel:
        v, y = V.dense(df, self.features_col), F.col(self.label_col).cast("double")
        d = V.dimension(df, v)
        if df.where(y != F.floor(y)).limit(1).count():
            raise ValueError("labels must be whole numbers")
        counts = made = df.select(y.alias("l"), F.posexplode(v).alias("i", "x")).select("l", "i", (F.col("x") + 0.0).alias("x")).groupBy("l", "i", "x").count().persist()
        try:
            if (most := counts.count()) > MOST_VALUES:
                raise ValueError(f"{most} different values of features and labels; a model holds at most {MOST_VALUES}: are the features categories?")
            counts = counts.collect()
        finally:
            made.unpersist()
        labels = sorted({r.l for r in counts})
        n = {k: sum(r["count"] for r in counts if r.l == k and r.i == 0) for k in labels}
        kinds: list[set[float]] = [set() for _ in range(d)]
        held: dict[tuple[float, int, float], int] = {}
        for r in counts:
            kinds[r.i].add(r.x)
            held[r.l, r.i, r.x] = r["count"]
        s, rows = self.smoothing, sum(n.values())
        log = lambda x: math.log(x) if x > 0 else -math.inf
        theta = [[{x: log(held.get((k, j, x), 0) + s) - log(n[k] + s * len(kinds[j])) for x in sorted(kinds[j])} for j in range(d)] for k in labels]
        pi = [log(n[k] * d + s) - log(rows * d + len(labels) * s) for k in labels]
        return self.model(NaiveBayesModel(), theta=theta, piArray=pi, labels=labels)


class _KnnParams(HasFeaturesCol, HasPredictionCol):
    k = Param("int", "neighbours that vote", 5, gt(0))


#: Numbers of training data that are broadcast at most; larger sets are compared block by block on the executors.
BROADCAST_NUMBERS = 4_000_000
_BLOCK = 4096
_ASKED = 512  # queries that meet a block at once: 16 MB of products
_AT_ONCE = 1 << 15  # pairs whose distances are taken at once


def _vote(labels: np.ndarray) -> float:
    """The most frequent label, the smallest of several."""
    kinds, n = np.unique(labels, return_counts=True)
    return float(kinds[n.argmax()])


def _matrix(v: pa.Array) -> np.ndarray:
    """The rows of a list column; vectors must be there and of one size."""
    d = pc.list_value_length(v)
    if v.null_count or pc.min(d) != pc.max(d):
        raise ValueError("vectors must not be null and must have one size")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


class _Best:
    """The ``k`` nearest of the training rows seen so far, of each row of ``x``; of equal distances those with the least ``at``."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k, self.square = x, k, (x * x).sum(axis=1)
        self.d, self.at, self.y = np.full((len(x), k), np.inf), np.full((len(x), k), 2**63 - 1), np.zeros((len(x), k))

    def meet(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        square = (x * x).sum(axis=1)
        sure = np.isfinite(square).all()
        turned = np.ascontiguousarray(x.T)
        for a in range(0, len(self.x), _ASKED):
            asked, own = self.x[a : a + _ASKED], self.square[a : a + _ASKED]
            if sure and np.isfinite(own).all():
                # |x|^2 - 2xy of a product is exact up to ``slack``; what may be among the k best is measured again
                near = asked @ turned
                near *= -2.0
                near += square
                slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (own + square.max())
                worst = self.d[a : a + _ASKED, -1] ** 2
                fresh = np.isinf(worst)
                if fresh.any() and len(x) > self.k:
                    worst[fresh] = np.partition(near[fresh], self.k - 1, axis=1)[:, self.k - 1] + own[fresh] + slack[fresh]
                q, t = np.nonzero(near <= (worst - own + slack)[:, None])
            else:
                q, t = (i.ravel() for i in np.indices((len(asked), len(x))))
            if len(q):
                self._take(q + a, t, x, at, y)

    def _take(self, q: np.ndarray, t: np.ndarray, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        d = np.empty(len(q))
        for a in range(0, len(q), _AT_ONCE):
            diff = self.x[q[a : a + _AT_ONCE]] - x[t[a : a + _AT_ONCE]]
            d[a : a + _AT_ONCE] = np.sqrt((diff * diff).sum(axis=1))
        self.merge(q, d, at[t], y[t])

    def merge(self, q: np.ndarray, d: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        d, at, y = (np.concatenate([held[rows].ravel(), new]) for held, new in ((self.d, d), (self.at, at), (self.y, y)))
        order = np.lexsort((at, d, q))
        first = np.searchsorted(q[order], rows)
        kept = order[(first[:, None] + np.arange(self.k)).ravel()]
        for held, new in ((self.d, d), (self.at, at), (self.y, y)):
            held[rows] = new[kept].reshape(-1, self.k)

    def votes(self) -> np.ndarray:
        return np.array([_vote(y[t < 2**63 - 1]) if t[0] < 2**63 - 1 else np.nan for y, t in zip(self.y, self.at, strict=True)])


def _training_blocks(rows: DataFrame, k: int) -> DataFrame:
    """Blocks of rows as bytes: ``at``, ``x``, ``y``.  Of equal vectors in a block only the ``k`` earliest can be among the k best."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), _BLOCK):
                at, v, y = (b.slice(a, _BLOCK).column(c) for c in range(3))
                at, x, y = at.to_numpy(zero_copy_only=False), _matrix(v).astype(float), y.to_numpy(zero_copy_only=False).astype(float)
                order = np.argsort(at, kind="stable")
                at, x, y = at[order], np.ascontiguousarray(x[order]), y[order]
                if x.shape[1]:
                    same = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
                    order = np.argsort(same, kind="stable")
                    start = np.concatenate([[0], np.flatnonzero(np.diff(same[order])) + 1])
                    place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
                    kept = np.sort(order[place < k])
                    at, x, y = at[kept], x[kept], y[kept]
                yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (at, x, y)], names=["at", "x", "y"])

    return rows.select("at", "x", "y").mapInArrow(pack, "at binary, x binary, y binary")


def _block(at: bytes, x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, y = np.frombuffer(at, np.int64), np.frombuffer(y)
    return np.frombuffer(x).reshape(len(at), -1), at, y


class KnnModel(Model, _KnnParams):
    """Majority vote of the nearest training rows by Euclidean distance; of equal distances the earlier row counts.

    The training set is the model.  Up to BROADCAST_NUMBERS it is sent to all tasks; a larger one stays a table, of which
    every block meets every block of queries, and only the k best of each query leave a task.
    """

    MODEL_SCHEMA = "packedFeatures array<array<double>>, featureNormSquares array<double>, labels array<double>"

    def with_table(self, rows: DataFrame, n: int, d: int):
        """``rows``: at, x, y, with ``at`` the order of the training rows."""
        self.rows, self.numbers = rows, n * d
        return self

    def set_model_data(self, frame: DataFrame):
        rows = frame.select(F.posexplode(F.arrays_zip("packedFeatures", "labels")).alias("at", "r")).select(F.col("at").cast("long").alias("at"), F.col("r.packedFeatures").alias("x"), F.col("r.labels").alias("y"))
        n = frame.agg(F.sum(F.size("labels"))).first()[0] or 0
        d = frame.select(F.size(F.get("packedFeatures", 0))).first()[0] if n else 0
        return self.with_table(rows, n, d)

    def get_model_data(self, spark: SparkSession) -> DataFrame:
        row = self.rows.agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("r"))
        square = lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)
        return row.select(F.transform("r", lambda e: e["x"]).alias("packedFeatures"), F.transform("r", lambda e: square(e["x"])).alias("featureNormSquares"), F.transform("r", lambda e: e["y"]).alias("labels"))

    def transform(self, df: DataFrame) -> DataFrame:
        k, train = self.k, _training_blocks(self.rows, self.k)
        if self.numbers <= BROADCAST_NUMBERS:
            held = df.sparkSession.sparkContext.broadcast([(bytes(r.at), bytes(r.x), bytes(r.y)) for r in train.collect()])

            @F.arrow_udf("double")
            def nearest(v: pa.Array) -> pa.Array:
                out = []
                for a in range(0, len(v), _BLOCK):
                    best = _Best(_matrix(v.slice(a, _BLOCK)), k)
                    for block in held.value:
                        best.meet(*_block(*block))
                    out.append(best.votes())
                return pa.array(np.concatenate(out) if out else np.zeros(0))

            return df.withColumn(self.prediction_col, nearest(V.dense(df, self.features_col)))
        queries = df.withColumn("__q", F.monotonically_increasing_id()).persist()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, len(b), _BLOCK):
                    q, v = (b.slice(a, _BLOCK).column(c) for c in range(2))
                    yield pa.RecordBatch.from_arrays([pa.array([q[0].as_py()]), *[pa.array([z.tobytes()], pa.binary()) for z in (q.to_numpy(), _matrix(v))]], names=["g", "q", "v"])

        asked = queries.select("__q", V.dense(queries, self.features_col).alias("v")).mapInArrow(pack, "g long, q binary, v binary")
        # few blocks a partition, so that the pairs of blocks spread over the cores
        cores = df.sparkSession.sparkContext.defaultParallelism
        blocks = train.select(F.col("at").alias("t"), "x", "y").repartition(max(1, self.numbers // BROADCAST_NUMBERS))
        asked = asked.repartition(4 * cores, "g")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[bytes, _Best]] = {}  # the k best of the queries of this partition
            for b in batches:
                for g, q, v, t, x, y in zip(*(b.column(c) for c in ("g", "q", "v", "t", "x", "y")), strict=True):
                    if (key := g.as_py()) not in held:
                        q = q.as_py()
                        held[key] = q, _Best(np.frombuffer(v.as_py()).reshape(len(q) // 8, -1), k)
                    held[key][1].meet(*_block(t.as_py(), x.as_py(), y.as_py()))
            for g, (q, made) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g]), *[pa.array([z], pa.binary()) for z in (q, made.d.tobytes(), made.at.tobytes(), made.y.tobytes())]], names=["g", "q", "d", "t", "y"])

        near = asked.crossJoin(blocks).mapInArrow(best, "g long, q binary, d binary, t binary, y binary")  # a stated set of queries against all rows, in blocks

        def final(frame: pd.DataFrame) -> pd.DataFrame:
            q = np.frombuffer(frame["q"].iloc[0], np.int64)
            made = _Best(np.zeros((len(q), 0)), k)
            for d, t, y in zip(frame["d"], frame["t"], frame["y"], strict=True):
                made.merge(np.repeat(np.arange(len(q)), k), np.frombuffer(d), np.frombuffer(t, np.int64), np.frombuffer(y))
            return pd.DataFrame({"q": q, "p": made.votes()})

        votes = near.groupBy("g").applyInPandas(final, "q long, p double")
        return queries.join(votes, F.col("__q") == F.col("q")).withColumn(self.prediction_col, F.col("p")).drop("__q", "q", "p")


class Knn(Estimator, _KnnParams, HasLabelCol):
    def fit(self, df: DataFrame) -> KnnModel:
        v = V.dense(df, self.features_col)
        d = V.dimension(df, v)
        rows = df.select(F.monotonically_increasing_id().alias("at"), v.alias("x"), F.col(self.label_col).cast("double").alias("y")).persist()
        made = self.model(KnnModel())
        return made.with_table(rows, rows.count(), d)
