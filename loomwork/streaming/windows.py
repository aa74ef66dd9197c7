"""Descriptions of windows, and how rows are assigned to them."""

from __future__ import annotations

from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.dataflow import batches

KINDS: dict[str, type[Window]] = {}


def millis(c: Column) -> Column:
    """Milliseconds since the epoch of a timestamp."""
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1000)


class Window:
    """A window of rows; ``size`` is a number of rows or of milliseconds."""

    by_time: ClassVar[bool] = True

    def __init__(self, size: int = 0):
        self.size = size

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        KINDS[cls.__name__] = cls

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.size == other.size

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.size))

    def to_dict(self) -> dict[str, Any]:
        return {"kind": type(self).__name__, "size": self.size}

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Window:
        return KINDS[d["kind"]](d["size"])

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        """Adds ``__window``, a number that orders the windows, and ``__end``, the last millisecond of each (null: none)."""
        raise NotImplementedError


def _time(time_col: str | None) -> Column:
    if time_col is None:
        raise ValueError("windows by time need a time column")
    return millis(F.col(time_col))


class GlobalWindows(Window):
    """All rows of a bounded input."""

    by_time = False

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        return df.withColumns({"__window": F.lit(0).cast("long"), "__end": F.lit(None).cast("long")})


class CountTumblingWindows(Window):
    """Every ``size`` rows, in the order of the time column or of the input; an incomplete last window never fires."""

    by_time = False

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        df = df.withColumn("__seq", F.monotonically_increasing_id())
        order = [F.col(time_col), F.col("__seq")] if time_col else [F.col("__seq")]
        return batches(df, order, self.size, "__window").withColumn("__end", F.lit(None).cast("long")).drop("__seq")


class EventTimeTumblingWindows(Window):
    """[k*size, (k+1)*size) milliseconds."""

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        k = F.floor(_time(time_col) / self.size)
        return df.withColumns({"__window": k, "__end": (k + 1) * self.size - 1})


class ProcessingTimeTumblingWindows(EventTimeTumblingWindows):
    """By the time of arrival: a time column if the rows carry one, else all of a batch arrive at once."""

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        if time_col is not None:
            return super().assign(df, time_col)
        return super().assign(df.withColumn("__now", F.current_timestamp()), "__now").drop("__now")


class EventTimeSessionWindows(Window):
    """Rows that follow each other by less than ``size`` milliseconds.

    Sessions of the whole table have no key to split by; rows are first reduced to distinct times, which are cut at time
    ranges: a gap is found from the last time of the nearest range before, one row per range.
    """

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        t = _time(time_col)
        times = df.select(t.alias("t")).where("t is not null").distinct().repartitionByRange("t").withColumn("part", F.spark_partition_id()).persist()
        ends = times.groupBy("part").agg(F.max("t").alias("last"))
        before = ends.select(F.col("part").alias("p"), F.max("last").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
        here = W.partitionBy("part").orderBy("t")
        marked = times.withColumn("prev", F.lag("t").over(here)).join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("prev", F.coalesce("prev", "carry"))
        fresh = marked.withColumn("new", (F.col("prev").isNull() | (F.col("t") - F.col("prev") >= self.size)).cast("long")).select("t", "part", "new").persist()
        so_far = fresh.groupBy("part").agg(F.sum("new").alias("n"))
        offset = so_far.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
        named = fresh.join(F.broadcast(offset), F.col("part") == F.col("p")).select("t", (F.sum("new").over(here) + F.col("off") - 1).alias("__window"))
        ends = named.groupBy("__window").agg((F.max("t") + self.size - 1).alias("__end"))
        return df.withColumn("__t", t).join(named.withColumnRenamed("t", "__s"), F.col("__t") == F.col("__s")).join(ends, "__window").drop("__t", "__s")


class ProcessingTimeSessionWindows(EventTimeSessionWindows):
    """By the time of arrival: a time column if the rows carry one, else all of a batch are one session."""

    def assign(self, df: DataFrame, time_col: str | None = None) -> DataFrame:
        return super().assign(df, time_col) if time_col is not None else GlobalWindows().assign(df)
