"""Stages: estimators, models, transformers and operators with several inputs or outputs; how they are stored."""

from __future__ import annotations

import json
import time
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .params import HasParams

#: Stage classes by name, for loading.
REGISTRY: dict[str, type[Stage]] = {}


def _metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/metadata", wholetext=True).collect()))


def write_metadata(spark: SparkSession, path: str, meta: dict[str, Any]) -> None:
    """Written by Spark, so that any file system that executors reach will do."""
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.text(f"{path}/metadata")


class Stage(HasParams):
    """Anything with parameters that can be saved and loaded.  A path that exists is an error."""

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        REGISTRY[cls.__name__] = cls

    def _extra(self) -> dict[str, Any]:
        return {}

    def save(self, spark: SparkSession, path: str) -> None:
        values = {k: v for k, v in self.param_map().items() if k in self._values}
        write_metadata(spark, path, {"class": type(self).__name__, "timestamp": int(time.time() * 1000), "params": {k: _encode(v) for k, v in values.items()}, **self._extra()})

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        meta = _metadata(spark, path)
        made = REGISTRY[meta["class"]]
        if not issubclass(made, cls):
            raise ValueError(f"{path} holds a {meta['class']}, not a {cls.__name__}")
        return made._load(spark, path, meta)

    @classmethod
    def _load(cls, spark: SparkSession, path: str, meta: dict[str, Any]):
        return cls(**{k: _decode(v) for k, v in meta["params"].items()})


def _encode(v: Any) -> Any:
    return {"window": v.to_dict()} if hasattr(v, "to_dict") else v


def _decode(v: Any) -> Any:
    if isinstance(v, dict) and "window" in v:
        from ..streaming.windows import Window

        return Window.from_dict(v["window"])
    return v


class AlgoOperator(Stage):
    """Takes one or more DataFrames and gives one or more."""

    def transform(self, *inputs: DataFrame) -> DataFrame | tuple[DataFrame, ...]:
        raise NotImplementedError


class Transformer(AlgoOperator):
    """Maps rows to rows: lazy, and an expression wherever possible, so that neighbouring stages collapse into one projection."""


class Model(Transformer):
    """A transformer with model data: a small record here, a DataFrame of ``MODEL_SCHEMA`` outside."""

    MODEL_SCHEMA: ClassVar[str] = ""

    def __init__(self, **values: Any):
        self.data: dict[str, Any] | None = None
        super().__init__(**values)

    def with_data(self, **data: Any):
        self.data = data
        return self

    def need(self) -> dict[str, Any]:
        if self.data is None:
            raise ValueError(f"{type(self).__name__} has no model data")
        return self.data

    def get_model_data(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in _split_schema(self.MODEL_SCHEMA)]
        return spark.createDataFrame([tuple(self.need()[n] for n in names)], self.MODEL_SCHEMA)

    def set_model_data(self, frame: DataFrame):
        row = frame.first()
        if row is None:
            raise ValueError("the model data has no row")
        self.data = row.asDict(recursive=True)
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        self.get_model_data(spark).coalesce(1).write.parquet(f"{path}/data")

    @classmethod
    def _load(cls, spark: SparkSession, path: str, meta: dict[str, Any]):
        return super()._load(spark, path, meta).set_model_data(spark.read.parquet(f"{path}/data"))


def _split_schema(schema: str) -> list[str]:
    out, depth, at = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(at.strip())
            at = ""
        else:
            at += c
    return [*out, at.strip()] if at.strip() else out


class Estimator(Stage):
    """``fit`` is eager: it runs the aggregations or rounds it needs and returns a model with its data on the driver."""

    def fit(self, *inputs: DataFrame) -> Model:
        raise NotImplementedError

    def model(self, made: Model, **data: Any) -> Model:
        made.copy_params(self)
        return made.with_data(**data)
