"""Estimators that learn batch by batch, and models that are versioned and may be too old for a row."""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..core import vectors as V
from ..core.params import HasBatchStrategy, HasDecayFactor, HasElasticNet, HasFeaturesCol, HasGlobalBatchSize, HasLabelCol, HasModelVersion, HasPredictionCol, HasRawPredictionCol, HasSeed, HasWeightCol, Param, gt, not_null
from ..core.stage import Estimator, Model
from ..functions.distance import pairwise
from ..operators.classification import LogisticRegressionModel
from ..operators.clustering import KMeansModel, KMeansModelParams
from ..operators.scalers import _StandardParams
from .windows import GlobalWindows, Window, millis


class ModelStore:
    """Versions of a model in a folder that Spark writes: one small file per finished micro-batch, named by its id.

    Writing a batch again replaces its file, so a restarted query that repeats its last batch leaves one version of each.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, batch_id: int, record: dict[str, Any]) -> None:
        text = self.spark.range(1).select(F.lit(json.dumps(record)).alias("value"))
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/batch={batch_id}")

    def batches(self) -> list[int]:
        """Ids of the batches stored so far, ascending, from the names of the files."""
        try:
            files = self.spark.read.text(self.path).inputFiles()
        except AnalysisException:  # no batch was stored yet
            return []
        return sorted({int(name.rsplit("/batch=", 1)[1].split("/")[0]) for name in files if "/batch=" in name})

    def get(self, batch_id: int) -> dict[str, Any]:
        return json.loads(self.spark.read.text(f"{self.path}/batch={batch_id}").first()[0]) | {"batch_id": batch_id}

    def all(self) -> list[dict[str, Any]]:
        if not self.batches():
            return []
        rows = self.spark.read.text(self.path).select("batch", "value").collect()
        return [json.loads(r.value) | {"batch_id": r.batch} for r in sorted(rows, key=lambda r: r.batch)]

    def before(self, batch_id: int) -> dict[str, Any] | None:
        """The record of the last batch before; no other file is read."""
        held = [b for b in self.batches() if b < batch_id]
        return self.get(held[-1]) if held else None


class CountBatchLearner(Estimator, HasGlobalBatchSize, HasBatchStrategy):
    """Learns from every ``global_batch_size`` rows; the state and the rows of an incomplete batch go from one to the next."""

    order_col = Param("str", "column that orders the rows; their order of arrival if not set")

    def initial(self) -> dict[str, Any]:
        raise NotImplementedError

    def update(self, state: dict[str, Any], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, Any]:
        raise NotImplementedError

    def rows_of(self, df: DataFrame) -> DataFrame:
        """The columns that learning needs: ``x``, ``y``, ``w``."""
        raise NotImplementedError

    def made(self, state: dict[str, Any], version: int) -> Model:
        raise NotImplementedError

    def _learnt(self, df: DataFrame, every: bool) -> tuple[list[dict[str, Any]], int]:
        """The states after the full batches of a bounded input, in order (the last alone, if not ``every``), and their number.

        A batch needs the state that the one before it left, so one task after the other learns from its range of the sorted
        rows.  Between them go the state and the rows of an incomplete batch; no other row leaves its task.
        """
        rows = self.rows_of(df).withColumn("__seq", F.col(self.order_col) if self.order_col else F.monotonically_increasing_id())
        order = ["__seq", "__tie"]
        ranges = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("x", "y", "w").persist()
        state, left, out, n = self.initial(), pickle.dumps([]), [], 0
        try:
            for part in range(ranges.rdd.getNumPartitions()):
                made = ranges.mapInArrow(self._range_learner(state, left, every), "state string, n long, rest binary").rdd
                *states, last = df.sparkSession.sparkContext.runJob(made, list, [part])
                out += [json.loads(r.state) for r in states]
                state, n, left = json.loads(last.state), n + last.n, bytes(last.rest)
        finally:
            ranges.unpersist()
        return (out if every else [state][: min(n, 1)]), n

    def _range_learner(self, state: dict[str, Any], left: bytes, every: bool) -> Any:
        size, update = self.global_batch_size, self.update

        def learn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row(s: dict[str, Any], n: int, rest: bytes) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([json.dumps(s)]), pa.array([n], pa.int64()), pa.array([rest], pa.binary())], names=["state", "n", "rest"])

            now, n, held = state, 0, pickle.loads(left)  # held: pieces of the batch to come
            count = sum(len(y) for _, y, _ in held)
            for b in frames:
                v, y, w = (b.column(c) for c in range(3))
                if v.null_count or len(pc.unique(pc.list_value_length(v))) > 1:
                    raise ValueError("vectors must not be null and must have one size")
                x, at = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), 0
                y, w = (c.to_numpy(zero_copy_only=False) for c in (y, w))
                while at < len(y):
                    end = min(len(y), at + size - count)
                    held.append((x[at:end], y[at:end], w[at:end]))
                    count, at = count + end - at, end
                    if count == size:
                        now, n, held, count = update(now, *map(np.concatenate, zip(*held, strict=True))), n + 1, [], 0
                        if every:
                            yield row(now, 0, b"")
            yield row(now, n, pickle.dumps([tuple(map(np.ascontiguousarray, h)) for h in held]))

        return learn

    def fit_versions(self, df: DataFrame) -> list[Model]:
        """The model after each full batch of a bounded input, in order."""
        return [self.made(state, version) for version, state in enumerate(self._learnt(df, True)[0])]

    def fit(self, df: DataFrame) -> Model:
        """The last version; the initial model if there is no full batch."""
        states, n = self._learnt(df, False)
        return self.made(states[-1], n - 1) if states else self.made(self.initial(), 0)

    def fit_stream(self, stream: DataFrame, store: ModelStore, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Learns from a stream; every micro-batch stores the versions it gave, the state and the rows left over."""
        size = self.global_batch_size

        def learn(df: DataFrame, batch_id: int) -> None:
            last = store.before(batch_id) or {"state": self.initial(), "left": [], "version": -1}
            state, version, held, made = last["state"], last["version"], [tuple(r) for r in last["left"]], []
            for r in self.rows_of(df).toLocalIterator():
                held.append((list(r.x), r.y, r.w))
                if len(held) == size:
                    state, version, held = self.update(state, *self._arrays(held)), version + 1, []
                    made.append({"version": version, "state": state})
            store.put(batch_id, {"state": state, "left": held, "version": version, "made": made})

        return self._start(stream, learn, checkpoint, trigger)

    @staticmethod
    def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)

    @staticmethod
    def _start(stream: DataFrame, learn: Any, checkpoint: str, trigger: dict[str, Any]) -> StreamingQuery:
        return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def stored_versions(self, store: ModelStore) -> list[Model]:
        return [self.made(m["state"], m["version"]) for r in store.all() for m in r["made"]]


class OnlineKMeansModel(KMeansModel):
    """K-means centroids of the latest version."""


class OnlineKMeans(CountBatchLearner, KMeansModelParams, HasDecayFactor, HasSeed):
    """Centroids as means that forget: what was learnt before a batch weighs ``decay_factor`` of itself."""

    initial_model = Param("any", "centroids and weights to start from", None, not_null)

    def rows_of(self, df: DataFrame) -> DataFrame:
        cols = [V.dense(df, self.features_col).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w")]
        return df.select(*cols, *([F.col(self.order_col)] if self.order_col else []))

    def initial(self) -> dict[str, Any]:
        centroids, weights = self.get("initial_model")
        return {"centroids": [list(map(float, c)) for c in centroids], "weights": [float(w) for w in weights]}

    def update(self, state: dict[str, Any], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, Any]:
        c, weights = np.array(state["centroids"]), np.array(state["weights"]) * self.decay_factor
        at = pairwise(self.distance_measure, x, c).argmin(axis=1)
        for k in range(len(c)):
            mine = x[at == k]
            if len(mine):
                c[k] = (c[k] * weights[k] + mine.sum(axis=0)) / (weights[k] + len(mine))
                weights[k] += len(mine)
        return {"centroids": c.tolist(), "weights": weights.tolist()}

    def made(self, state: dict[str, Any], version: int) -> OnlineKMeansModel:
        return self.model(OnlineKMeansModel(), **state)


class _OnlineLRModelParams(HasFeaturesCol, HasPredictionCol, HasRawPredictionCol):
    model_version_col = Param("str", "name of the model version column", "modelVersion", not_null)


class OnlineLogisticRegressionModel(LogisticRegressionModel, _OnlineLRModelParams):
    """A logistic model that tells its version with every prediction."""

    def transform(self, df: DataFrame) -> DataFrame:
        return super().transform(df).withColumn(self.model_version_col, F.lit(int(self.need()["modelVersion"])).cast("long"))


class OnlineLogisticRegression(CountBatchLearner, _OnlineLRModelParams, HasLabelCol, HasWeightCol, HasElasticNet):
    """FTRL-proximal updates, one per batch; versions count from 1."""

    alpha = Param("float", "learning rate", 0.1, gt(0.0))
    beta = Param("float", "smoothing of the learning rate", 0.1, gt(0.0))
    initial_model = Param("floats", "coefficients to start from", None, not_null)

    def rows_of(self, df: DataFrame) -> DataFrame:
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        dense = V.kind(df, self.features_col) != "sparse"  # weight 0 marks a dense row
        cols = [V.dense(df, self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y"), (F.lit(0.0) if dense else weight).alias("w")]
        return df.select(*cols, *([F.col(self.order_col)] if self.order_col else []))

    def initial(self) -> dict[str, Any]:
        coef = [float(c) for c in self.get("initial_model")]
        return {"coef": coef, "z": [0.0] * len(coef), "n": [0.0] * len(coef)}

    def update(self, state: dict[str, Any], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, Any]:
        """A sparse row counts with its weight only where it has entries, a dense one with 1 everywhere; the gradient has no weights."""
        coef, z, n = (np.array(state[k]) for k in ("coef", "z", "n"))
        slope = 1 / (1 + np.exp(-np.clip(x @ coef, -700, 700))) - y
        total = np.where(w[:, None] == 0, 1.0, (x != 0) * w[:, None]).sum(axis=0)
        g = np.where(total > 0, (slope @ x) / np.where(total > 0, total, 1), 0.0)
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        z = z + g - sigma * coef
        n = n + g * g
        l1, l2 = self.elastic_net * self.reg, (1 - self.elastic_net) * self.reg
        coef = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + l2))
        return {"coef": coef.tolist(), "z": z.tolist(), "n": n.tolist()}

    def made(self, state: dict[str, Any], version: int) -> OnlineLogisticRegressionModel:
        return self.model(OnlineLogisticRegressionModel(), coefficient=state["coef"], modelVersion=version + 1)


class OnlineStandardScalerModel(Model, _StandardParams, HasModelVersion):
    """Scales every row with the earliest version that is fresh enough for it: timestamp >= row time - allowed delay.

    Rows that no version is fresh enough for wait: they are not in the result.  Without a time column the latest version
    serves all rows.
    """

    MODEL_SCHEMA = "version bigint, timestamp bigint, mean array<double>, std array<double>"
    time_col = Param("str", "event time of a row")

    def with_versions(self, versions: DataFrame):
        self.versions = versions
        return self

    def get_model_data(self, spark: SparkSession) -> DataFrame:
        return self.versions

    def set_model_data(self, frame: DataFrame):
        return self.with_versions(frame)

    def transform(self, df: DataFrame) -> DataFrame:
        v = V.dense(df, self.input_col)
        stamps = [(r.version, r.timestamp) for r in self.versions.select("version", "timestamp").orderBy("version").collect()]  # two numbers per window
        if not stamps:
            return df.limit(0)
        if self.time_col:
            # versions ascend in time, so the first that is fresh enough is the earliest: a binary search per row
            held = df.sparkSession.sparkContext.broadcast(np.array([t for _, t in stamps], np.int64))

            @F.arrow_udf("int")
            def earliest(need: pa.Array) -> pa.Array:
                at = np.searchsorted(held.value, need.fill_null(2**63 - 1).to_numpy(zero_copy_only=False), side="left")
                return pa.array(at.astype(np.int32), mask=(at >= len(held.value)) | np.asarray(need.is_null()))

            df = df.withColumn("__k", earliest(millis(F.col(self.time_col)) - self.max_allowed_model_delay_ms)).where("__k is not null")
        else:
            df = df.withColumn("__k", F.lit(len(stamps) - 1))
        made = self.versions.select((F.row_number().over(W.orderBy("version")) - 1).alias("__v"), F.col("version").alias("__version"), F.col("mean").alias("__mean"), F.col("std").alias("__std"))
        wide = len(stamps) * (self.versions.select(F.max(F.size("mean"))).first()[0] or 0)
        df = df.join(F.broadcast(made) if wide <= 1_000_000 else made, F.col("__k") == F.col("__v"))
        out = F.zip_with(v, F.col("__mean"), lambda x, m: x - m) if self.with_mean else v
        if self.with_std:
            out = F.zip_with(out, F.col("__std"), lambda x, s: F.when(s == 0, 0.0).otherwise(x / s))
        df = df.withColumn(self.output_col, V.like(df, self.input_col, out))
        if self.model_version_col:
            df = df.withColumn(self.model_version_col, F.col("__version"))
        return df.drop("__k", "__v", "__version", "__mean", "__std")


class OnlineStandardScaler(Estimator, _StandardParams, HasModelVersion):
    """Mean and standard deviation of everything up to the end of each window that has rows; versions count from 0."""

    windows = Param("any", "windows after which a version is made", GlobalWindows(), not_null)
    time_col = Param("str", "event time of a row, for windows by time")

    def versions(self, df: DataFrame) -> DataFrame:
        """``version, timestamp, mean, std`` by sums per window and running totals over the windows, a row each."""
        window: Window = self.windows
        v = V.dense(df, self.input_col)
        rows = window.assign(df, self.time_col).select("__window", "__end", F.posexplode(v).alias("i", "x"))
        sums = rows.groupBy("__window", "i").agg(F.max("__end").alias("end"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
        run = W.partitionBy("i").orderBy("__window").rowsBetween(W.unboundedPreceding, W.currentRow)
        total = sums.select("__window", "i", "end", *[F.sum(c).over(run).alias(c) for c in ("s", "q", "n")])
        mean = F.col("s") / F.col("n")
        var = F.when(F.col("n") > 1, (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)).otherwise(0.0)
        parts = total.select("__window", "end", F.struct("i", mean.alias("m"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("d")).alias("e"))
        made = parts.groupBy("__window").agg(F.max("end").alias("end"), F.array_sort(F.collect_list("e")).alias("es"))
        version = F.row_number().over(W.orderBy("__window")) - 1  # over one row per window
        return made.select(version.cast("long").alias("version"), F.coalesce("end", F.lit(2**63 - 1)).alias("timestamp"), F.transform("es", lambda e: e["m"]).alias("mean"), F.transform("es", lambda e: e["d"]).alias("std"))

    def fit(self, df: DataFrame) -> OnlineStandardScalerModel:
        made = OnlineStandardScalerModel()
        made.copy_params(self)
        return made.with_versions(self.versions(df).persist())

    def fit_stream(self, stream: DataFrame, store: ModelStore, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Learns from a stream by event time windows: each micro-batch adds its windows' sums, and its last window stays open.

        A row of a window that was closed before is late: it changes no version, so that their timestamps ascend, and is
        counted in the record's ``late``.
        """

        def learn(df: DataFrame, batch_id: int) -> None:
            last = store.before(batch_id) or {"open": {}, "total": None, "version": -1, "closed": "", "late": 0}
            closed, late = last["closed"], last["late"]
            open_: dict[str, list] = dict(last["open"])
            rows = self.windows.assign(df, self.time_col).select("__window", "__end", F.posexplode(V.dense(df, self.input_col)).alias("i", "x"))
            sums = rows.groupBy("__window", "__end", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
            for r in sums.orderBy("__window", "i").collect():  # a few numbers per window
                name = f"{r['__window']:020d}"
                if name <= closed:
                    late += r.n if r.i == 0 else 0
                    continue
                at = open_.setdefault(name, [r["__end"], {}])
                s, q, n = at[1].get(str(r.i), (0.0, 0.0, 0))
                at[1][str(r.i)] = (s + r.s, q + r.q, n + r.n)
            total, version, made = last["total"], last["version"], []
            for name in sorted(open_)[:-1]:
                end, parts = open_.pop(name)
                closed = name
                total = {i: [a + b for a, b in zip(total[i], p, strict=True)] for i, p in parts.items()} if total else {i: list(p) for i, p in parts.items()}
                version += 1
                made.append(self._version(total, version, end))
            store.put(batch_id, {"open": open_, "total": total, "version": version, "made": made, "closed": closed, "late": late})

        return CountBatchLearner._start(stream, learn, checkpoint, trigger)

    @staticmethod
    def _version(total: dict[str, list], version: int, end: int) -> dict[str, Any]:
        order = sorted(total, key=int)
        mean = [total[i][0] / total[i][2] for i in order]
        std = [math.sqrt(max(0.0, (total[i][1] - total[i][2] * m * m) / (total[i][2] - 1))) if total[i][2] > 1 else 0.0 for i, m in zip(order, mean, strict=True)]
        return {"version": version, "timestamp": end, "mean": mean, "std": std}

    def stored(self, spark: SparkSession, store: ModelStore) -> OnlineStandardScalerModel:
        rows = [(m["version"], m["timestamp"], m["mean"], m["std"]) for r in store.all() for m in r["made"]]
        made = OnlineStandardScalerModel()
        made.copy_params(self)
        return made.with_versions(spark.createDataFrame(rows, OnlineStandardScalerModel.MODEL_SCHEMA))
