"""K-means and agglomerative clustering."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import vectors as V
from ..core.params import HasDistanceMeasure, HasFeaturesCol, HasMaxIter, HasPredictionCol, HasSeed, Param, gt, in_array, not_null
from ..core.stage import AlgoOperator, Estimator, Model
from ..functions.distance import pairwise
from ..streaming.windows import GlobalWindows, Window
from .linear import matrix


class KMeansModelParams(HasDistanceMeasure, HasFeaturesCol, HasPredictionCol):
    k = Param("int", "clusters", 2, gt(1))


def distances(v: Column, centroids: list[list[float]], measure: str) -> Column:
    """What orders the centroids by their distance, as straight compiled sums; NaN is the greatest."""
    out = []
    for c in centroids:
        diff = [F.get(v, i) - F.lit(float(x)) for i, x in enumerate(c)]
        if measure == "manhattan":
            d = reduce(operator.add, (F.abs(x) for x in diff))
        elif measure == "euclidean":
            d = reduce(operator.add, (x * x for x in diff))
        else:
            size = float(np.linalg.norm(c))
            d = -reduce(operator.add, (F.get(v, i) * F.lit(float(x) / size) for i, x in enumerate(c))) if size else F.lit(0.0)
        out.append(d)
    return F.array(*out)


class KMeansModel(Model, KMeansModelParams):
    MODEL_SCHEMA = "centroids array<array<double>>, weights array<double>"

    def transform(self, df: DataFrame) -> DataFrame:
        centroids, v, measure = self.need()["centroids"], V.dense(df, self.features_col), self.distance_measure
        if len(centroids) * len(centroids[0]) <= 64:  # more terms than that outgrow what the compiler takes as one method
            near = df.withColumn("__d", F.when(v.isNotNull(), distances(v, centroids, measure)))
            return near.withColumn(self.prediction_col, (F.array_position("__d", F.array_min("__d")) - 1).cast("int")).drop("__d")
        held = df.sparkSession.sparkContext.broadcast(np.array(centroids, float))

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            return pd.Series(pairwise(measure, np.array(x.tolist(), float), held.value).argmin(axis=1).astype(np.int32)) if len(x) else pd.Series([], dtype="int32")

        return df.withColumn(self.prediction_col, nearest(v))


class KMeans(Estimator, KMeansModelParams, HasSeed, HasMaxIter):
    """Lloyd's algorithm: exactly ``max_iter`` rounds from ``k`` rows drawn at random, or given ones.

    A cluster that loses all rows has NaN for a centroid.  A round sends the centroids out and one sum per cluster and
    task back.
    """

    init_mode = Param("str", "random", "random", in_array(("random",)))
    initial_centroids = Param("floats2", "start from these instead of a draw")

    def _start(self, rows: DataFrame) -> np.ndarray:
        if self.initial_centroids is not None:
            return np.array(self.initial_centroids, float)
        drawn = [r.v for r in rows.orderBy(F.rand(self.actual_seed())).limit(self.k).collect()]  # a top-k per task, k rows here
        return np.array(drawn, float)

    def fit(self, df: DataFrame) -> KMeansModel:
        rows = df.select(V.dense(df, self.features_col).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            d, measure, sc = V.dimension(rows, F.col("v")), self.distance_measure, df.sparkSession.sparkContext
            centroids = self._start(rows)
            k, counts = len(centroids), np.zeros(len(centroids))
            for _ in range(self.max_iter):
                held = sc.broadcast(centroids)

                def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                    total = np.zeros((k, d + 1))
                    for b in batches:
                        x = matrix(b.column("v"), d)
                        dist = pairwise(measure, x, np.nan_to_num(held.value, nan=np.inf)) if measure != "cosine" else pairwise(measure, x, held.value)
                        at = np.nan_to_num(dist, nan=np.inf).argmin(axis=1)
                        np.add.at(total[:, :d], at, x)
                        total[:, d] += np.bincount(at, minlength=k)
                    yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

                total = np.sum([r.s for r in rows.mapInArrow(sums, "s array<double>").collect()], axis=0).reshape(k, d + 1)
                held.unpersist()
                counts = total[:, d]
                with np.errstate(invalid="ignore", divide="ignore"):
                    centroids = total[:, :d] / counts[:, None]
            return self.model(KMeansModel(), centroids=centroids.tolist(), weights=counts.tolist())
        finally:
            rows.unpersist()


class AgglomerativeClustering(AlgoOperator, HasDistanceMeasure, HasFeaturesCol, HasPredictionCol):
    """Merges clusters bottom up, over each window of rows; gives the rows with their cluster, and the log of merges.

    The distances of a window's rows are one matrix, so a window is bounded by the memory of a task; that lies in the
    method.  Clusters are numbered by their first row.
    """

    num_clusters = Param("int", "clusters to stop at", 2)
    distance_threshold = Param("float", "distance beyond which nothing is merged; num_clusters must then be null")
    linkage = Param("str", "ward, complete, average or single", "ward", in_array(("ward", "complete", "average", "single")))
    compute_full_tree = Param("bool", "whether the log goes on to a single cluster", False)
    windows = Param("any", "windows of rows that are clustered apart", GlobalWindows(), not_null)
    time_col = Param("str", "event time of a row, for windows by time")

    def merges(self, x: np.ndarray) -> list[tuple[int, int, float, int]]:
        """All merges by nearest-neighbour chains, in ascending distance: clusters n, n+1, ... are made in this order."""
        n = len(x)
        dist = pairwise(self.distance_measure, x, x)
        np.fill_diagonal(dist, np.inf)
        size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
        for _ in range(n - 1):
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            while True:
                a = chain[-1]
                row = np.where(alive, dist[a], np.inf)
                row[a] = np.inf
                b = int(row.argmin())
                if len(chain) > 1 and dist[a, chain[-2]] <= row[b]:
                    b = chain[-2]
                    break
                chain.append(b)
            chain = chain[:-2]
            a, b = min(a, b), max(a, b)
            gap = dist[a, b]
            found.append((gap, a, b))
            na, nb = size[a], size[b]
            if self.linkage == "ward":
                new = np.sqrt(np.maximum(((na + size) * dist[a] ** 2 + (nb + size) * dist[b] ** 2 - size * gap**2) / (na + nb + size), 0))
            elif self.linkage == "complete":
                new = np.maximum(dist[a], dist[b])
            elif self.linkage == "single":
                new = np.minimum(dist[a], dist[b])
            else:
                new = (na * dist[a] + nb * dist[b]) / (na + nb)
            dist[a], dist[:, a] = new, new
            dist[a, a], alive[b], size[a] = np.inf, False, na + nb
        found.sort(key=lambda m: m[0])
        root, out = list(range(n)), []
        name, count = list(range(n)), [1] * n

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for step, (gap, a, b) in enumerate(found):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
            a, b = min(a, b), max(a, b)
            count[a] += count[b]
            out.append((*sorted((name[a], name[b])), float(gap), count[a]))
            name[a] = n + step
        return out

    def cluster(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float, int]]]:
        if not len(x):
            return np.zeros(0, np.int32), []
        log = self.merges(x)
        n = len(x)
        take = [m for m in log if m[2] <= self.distance_threshold] if self.distance_threshold is not None else log[: max(0, n - self.num_clusters)]
        parent = list(range(2 * n))
        for step, (a, b, _, _) in enumerate(take):
            parent[a] = parent[b] = n + step
        ids: dict[int, int] = {}
        out = np.zeros(n, np.int32)
        for i in range(n):
            at = i
            while parent[at] != at:
                at = parent[at]
            out[i] = ids.setdefault(at, len(ids))
        return out, log if self.compute_full_tree else take

    def transform(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        if (self.num_clusters is None) == (self.distance_threshold is None):
            raise ValueError("either num_clusters or distance_threshold must be set, and the other null")
        if self.linkage == "ward" and self.distance_measure != "euclidean":
            raise ValueError("ward linkage needs Euclidean distances")
        window: Window = self.windows
        placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__v", V.dense(df, self.features_col))
        tagged = window.assign(placed, self.time_col).persist()
        schema = T.StructType([*df.schema.fields, T.StructField(self.prediction_col, T.IntegerType())])
        names, me = df.columns, self

        def rows(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("__at")
            out = frame[names].copy()
            out[me.prediction_col] = me.cluster(np.array(frame["__v"].tolist(), float))[0]
            return out

        def log(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("__at")
            return pd.DataFrame(me.cluster(np.array(frame["__v"].tolist(), float))[1], columns=["clusterId1", "clusterId2", "distance", "sizeOfMergedCluster"])

        grouped = tagged.groupBy("__window")
        return grouped.applyInPandas(rows, schema), grouped.applyInPandas(log, "clusterId1 long, clusterId2 long, distance double, sizeOfMergedCluster long")
