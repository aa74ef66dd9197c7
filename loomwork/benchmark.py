"""Benchmarks from a JSON file: ``python -m loomwork.benchmark config.json [--output-file out.json]``.

A config maps names to ``{"stage": {"className", "paramMap"}, "inputData": {...}, "modelData": {...}}``; parameters may be
written in camel case.  An estimator is timed with its fit, other stages with a transform whose rows are counted and
dropped.  A config that fails is reported with its error and the others go on.
"""

from __future__ import annotations

import argparse
import json
import re
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import operators  # noqa: F401  registers the stages
from .core.params import HasParams
from .core.stage import REGISTRY, Estimator, Model
from .sources.generators import GENERATORS, count_and_discard


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def _made(kinds: dict[str, type], spec: dict[str, Any]) -> Any:
    name = spec["className"].rsplit(".", 1)[-1]
    if name not in kinds:
        raise ValueError(f"there is no {name}")
    kind: type[HasParams] = kinds[name]
    given = {snake(k): v for k, v in (spec.get("paramMap") or {}).items()}
    known = kind.params()
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    for k, v in given.items():
        if isinstance(v, dict) and "values" in v:
            given[k] = v["values"]
        elif known[k].kind == "float" and isinstance(v, int):
            given[k] = float(v)
    return kind(**given)


def run_one(spark: SparkSession, spec: dict[str, Any]) -> dict[str, Any]:
    """The config's timing: rows in and out a second, and milliseconds in all."""
    stage = _made(REGISTRY, spec["stage"])
    source = _made(GENERATORS, spec["inputData"])
    began = time.perf_counter()
    df: DataFrame = source.generate(spark)
    if isinstance(stage, Model) and "modelData" in spec:
        stage.set_model_data(_made(GENERATORS, spec["modelData"]).generate(spark))
    if isinstance(stage, Estimator):
        out = 0
        made = stage.fit(df)
        out = made.get_model_data(spark).count() if made.MODEL_SCHEMA else 1
    else:
        got = stage.transform(df)
        out = sum(count_and_discard(t) for t in (got if isinstance(got, tuple) else (got,)))
    ms = (time.perf_counter() - began) * 1000
    n = source.num_values
    return {"totalTimeMs": round(ms, 1), "inputRecordNum": n, "inputThroughput": round(n * 1000 / ms, 3), "outputRecordNum": out, "outputThroughput": round(out * 1000 / ms, 3)}


def run(spark: SparkSession, configs: dict[str, Any]) -> dict[str, Any]:
    out = {}
    for name, spec in configs.items():
        if name == "version":
            continue
        try:
            out[name] = {**spec, "results": run_one(spark, spec)}
        except Exception as e:  # noqa: BLE001  one bad config must not end the others
            out[name] = {**spec, "exception": f"{type(e).__name__}: {str(e)[:500]}"}
    return out


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("config")
    args.add_argument("--output-file")
    given = args.parse_args()
    spark = SparkSession.builder.appName("loomwork-benchmark").getOrCreate()
    with open(given.config) as f:
        text = json.dumps(run(spark, json.load(f)), indent=2)
    if given.output_file:
        with open(given.output_file, "w") as f:
            f.write(text)
    else:
        print(text)
    spark.stop()


if __name__ == "__main__":
    main()
