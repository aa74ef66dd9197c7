"""Partition-level building blocks over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

A = TypeVar("A")


def map_partition(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Runs ``f`` once per partition over its batches."""
    return df.mapInPandas(f, schema)


def reduce_all(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Reduces all rows to one with an associative ``f``: first each partition, then the one row of each in one task.

    Empty partitions give nothing; an empty input gives an empty result.
    """

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if len(frame):
                held = f(frame if held is None else pd.concat([held, frame], ignore_index=True))
        if held is not None:
            yield held

    return df.mapInPandas(part, df.schema).repartition(1).mapInPandas(part, df.schema)


def reduce_keyed(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Reduces the rows of each key to one."""
    return df.groupBy(key).applyInPandas(f, df.schema)


def aggregate(df: DataFrame, create: Callable[[], A], add: Callable[[A, pd.DataFrame], A], merge: Callable[[A, A], A], result: Callable[[A], Any]) -> Any:
    """A user aggregate: one accumulator per partition, merged on the driver; given even for an empty input."""
    from pyspark import cloudpickle

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = create()
        for frame in frames:
            acc = add(acc, frame)
        yield pd.DataFrame({"acc": [cloudpickle.dumps(acc)]})

    acc = create()
    for r in df.mapInPandas(part, "acc binary").collect():  # one row per partition, computed side by side
        acc = merge(acc, cloudpickle.loads(bytes(r.acc)))
    return result(acc)


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, uniformly: the least of seeded random numbers, a top-n per partition first."""
    return df.orderBy(F.rand(seed)).limit(n)


def all_reduce_sum(df: DataFrame, column: str) -> np.ndarray:
    """Element-wise sum of an array column; unequal lengths are an error.  Only one array per partition leaves the tasks."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError("arrays of unequal lengths")
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect()
    return np.array([s for _, s in sorted(map(tuple, rows))], float)


def co_group(a: DataFrame, b: DataFrame, key_a: str, key_b: str, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """All rows of both sides with one key meet in ``f``; keys of one side only come with an empty other side."""
    return a.groupBy(key_a).cogroup(b.groupBy(key_b)).applyInPandas(f, schema)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in a total order: range partitions, a running count inside each, and offsets.

    No task holds more than its range; ties are in the order of ``order``'s last columns, which should be unique.
    """
    sorted_ = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    counts = sorted_.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    inside = sorted_.withColumn("__r", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("__r") + F.col("__off")).drop("__part", "__p", "__off", "__r")


def batches(df: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Cuts the rows, in order, into batches of ``size``; the incomplete last one is left out."""
    ranked = global_rank(df, order, "__rank").persist()
    full = ranked.count() // size
    return ranked.withColumn(name, F.floor(F.col("__rank") / size)).where(F.col(name) < full).drop("__rank")


def with_broadcast(df: DataFrame, values: dict[str, Any], f: Callable[[DataFrame, dict[str, Any]], DataFrame]) -> DataFrame:
    """Gives ``f`` broadcast variables by name; DataFrames of one row are gathered first."""
    sc = df.sparkSession.sparkContext
    return f(df, {k: sc.broadcast(v.collect() if isinstance(v, DataFrame) else v) for k, v in values.items()})
