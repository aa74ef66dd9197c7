"""Mini-batch gradient descent for linear models: rounds on the driver, gradients where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasElasticNet, HasFeaturesCol, HasGlobalBatchSize, HasLabelCol, HasMaxIter, HasWeightCol, Param, gt, gt_eq

#: A loss maps (dot, label) to the loss and its derivative by the dot.
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def logistic_loss(dot: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    margin = dot * sign
    return np.logaddexp(0, -margin), -sign / (1 + np.exp(np.clip(margin, -700, 700)))


def hinge_loss(dot: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    gap = 1 - sign * dot
    return np.maximum(gap, 0), np.where(gap > 0, -sign, 0.0)


def square_loss(dot: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 0.5 * (dot - y) ** 2, dot - y


def regularise(coef: np.ndarray, reg: float, net: float, rate: float) -> np.ndarray:
    """A step of the elastic net: shrinking by the L2 share, a step against the sign by the L1 share."""
    if reg == 0:
        return coef
    if net == 0:
        return coef * (1 - rate * reg)
    if net == 1:
        return coef - rate * reg * np.sign(coef)
    return coef - rate * reg * (net * np.sign(coef) + (1 - net) * coef)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of ``d`` doubles each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class SGDParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasElasticNet, HasGlobalBatchSize):
    learning_rate = Param("float", "step size", 0.1, gt(0))
    tol = Param("float", "mean loss at which to stop", 1e-6, gt_eq(0))


def descend(stage: SGDParams, df: DataFrame, loss: Loss, binary: bool) -> list[float]:
    """Coefficients after the rounds; there is no intercept, and training starts at zero.

    The rows are dealt out evenly and kept (memory and disk).  A task's share of a batch is a slice of its rows in turn,
    the first tasks taking one more where it does not divide; after the last, shorter slice comes the first again.  A
    round sends the coefficients out and one sum of d+2 numbers per task back.  With a batch as large as the table every
    round takes all rows, and the result does not depend on how they are dealt.
    """
    weight = F.col(stage.weight_col).cast("double") if stage.weight_col else F.lit(1.0)
    rows = df.select(V.dense(df, stage.features_col).alias("x"), F.col(stage.label_col).cast("double").alias("y"), weight.alias("w"))
    check = rows.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"), F.count("*").alias("n"), F.sum((~F.col("y").isin(0.0, 1.0)).cast("long")).alias("odd")).first()
    if not check.n:
        raise ValueError("the training set is empty")
    if check.a != check.b:
        raise ValueError(f"vectors of {check.a} and of {check.b} elements")
    if binary and check.odd:
        raise ValueError("labels must be 0 or 1")
    d, tasks = check.a, max(1, df.sparkSession.sparkContext.defaultParallelism)
    tasks = min(tasks if check.n * d < 1 << 26 else max(tasks, check.n * d >> 23), max(1, check.n))
    full = stage.global_batch_size >= check.n
    dealt = rows if full else rows.repartition(tasks)
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    size, sc = stage.global_batch_size, df.sparkSession.sparkContext
    coef = np.zeros(d)
    try:
        for step in range(stage.max_iter):
            held = sc.broadcast(coef)

            def gradient(batches: Iterator[pa.RecordBatch], held=held, step=step) -> Iterator[pa.RecordBatch]:
                from pyspark import TaskContext

                total, now = np.zeros(d + 2), held.value
                if full:
                    parts = ((matrix(b.column("x"), d), b.column("y").to_numpy(), b.column("w").to_numpy()) for b in batches)
                else:
                    task = TaskContext.get().partitionId()
                    mine = size // tasks + (task < size % tasks)
                    held_ = [(matrix(b.column("x"), d), b.column("y").to_numpy(), b.column("w").to_numpy()) for b in batches]
                    if not held_ or not mine:
                        parts = iter(())
                    else:
                        x, y, w = (np.concatenate([h[k] for h in held_]) for k in range(3))
                        slices = -(-len(x) // mine)
                        at = slice((step % slices) * mine, (step % slices + 1) * mine)
                        parts = iter([(x[at], y[at], w[at])])
                for x, y, w in parts:
                    value, slope = loss(x @ now, y)
                    total[:d] += (w * slope) @ x
                    total[d] += w.sum()
                    total[d + 1] += (w * value).sum()
                yield pa.RecordBatch.from_pydict({"g": pa.array([total.tolist()], pa.list_(pa.float64()))})

            total = np.sum([r.g for r in dealt.mapInArrow(gradient, "g array<double>").collect()], axis=0)
            held.unpersist()
            if total[d] > 0:
                coef = regularise(coef - stage.learning_rate / total[d] * total[:d], stage.reg, stage.elastic_net, stage.learning_rate)
                if total[d + 1] / total[d] <= stage.tol:
                    break
    finally:
        dealt.unpersist()
    return [float(c) for c in coef]


def dot_with(v: Column, coef: list[float]) -> Column:
    """The dot product with constants: a straight sum up to a width, a fold beyond."""
    if len(coef) <= V.WIDE:
        out = F.lit(0.0)
        for k, c in enumerate(coef):
            out = out + F.get(v, k) * F.lit(c)
        return out
    return F.aggregate(F.zip_with(v, V.lit_array(coef), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
