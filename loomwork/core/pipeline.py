"""Sequences and graphs of stages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .stage import AlgoOperator, Estimator, Model, Stage


def _tables(x: DataFrame | tuple[DataFrame, ...] | list[DataFrame]) -> tuple[DataFrame, ...]:
    return tuple(x) if isinstance(x, tuple | list) else (x,)


def _one(x: tuple[DataFrame, ...]) -> DataFrame | tuple[DataFrame, ...]:
    return x[0] if len(x) == 1 else x


def save_stages(spark: SparkSession, path: str, stages: list[Stage]) -> None:
    for k, s in enumerate(stages):
        s.save(spark, f"{path}/stages/{k:03d}")


def load_stages(spark: SparkSession, path: str, n: int) -> list[Stage]:
    return [Stage.load(spark, f"{path}/stages/{k:03d}") for k in range(n)]


class Pipeline(Estimator):
    """Fits its estimators from left to right; what stands after the last one is not run while fitting."""

    def __init__(self, stages: list[Stage] | None = None, **values: Any):
        self.stages = list(stages or [])
        super().__init__(**values)

    def fit(self, *inputs: DataFrame) -> PipelineModel:
        last = max((k for k, s in enumerate(self.stages) if isinstance(s, Estimator)), default=-1)
        now, fitted = inputs, []
        for k, s in enumerate(self.stages):
            done = s.fit(*now) if isinstance(s, Estimator) else s
            fitted.append(done)
            if k < last:
                now = _tables(done.transform(*now))
        return PipelineModel(fitted)

    def _extra(self) -> dict[str, Any]:
        return {"stages": len(self.stages)}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        save_stages(spark, path, self.stages)

    @classmethod
    def _load(cls, spark: SparkSession, path: str, meta: dict[str, Any]):
        return cls(load_stages(spark, path, meta["stages"]))


class PipelineModel(Model):
    """Applies its stages in turn; projections of neighbouring stages become one in the plan."""

    def __init__(self, stages: list[AlgoOperator] | None = None, **values: Any):
        self.stages = list(stages or [])
        super().__init__(**values)

    def transform(self, *inputs: DataFrame) -> DataFrame | tuple[DataFrame, ...]:
        now = inputs
        for s in self.stages:
            now = _tables(s.transform(*now))
        return _one(now)

    def _extra(self) -> dict[str, Any]:
        return {"stages": len(self.stages)}

    def save(self, spark: SparkSession, path: str) -> None:
        Stage.save(self, spark, path)
        save_stages(spark, path, self.stages)

    @classmethod
    def _load(cls, spark: SparkSession, path: str, meta: dict[str, Any]):
        return cls(load_stages(spark, path, meta["stages"]))


class TableId:
    """Stands for a DataFrame while a graph is built."""

    def __init__(self, number: int):
        self.number = number


class _Node:
    def __init__(self, number: int, stage: Stage):
        self.number, self.stage = number, stage
        self.fit_in: list[int] | None = None
        self.inputs: list[int] = []
        self.outputs: list[int] = []
        self.model_in: list[int] | None = None
        self.model_out: list[int] | None = None

    def to_dict(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("number", "fit_in", "inputs", "outputs", "model_in", "model_out")}


#: Outputs that a node may have.
MOST_OUTPUTS = 20


class GraphBuilder:
    """Builds directed acyclic graphs of stages over symbolic tables; each stage may be added once."""

    def __init__(self):
        self._count = 0
        self._nodes: list[_Node] = []
        self._made: dict[int, _Node] = {}

    def create_table_id(self) -> TableId:
        self._count += 1
        return TableId(self._count - 1)

    def _node(self, stage: Stage) -> _Node:
        if id(stage) in self._made:
            raise ValueError("the stage is already in the graph")
        node = self._made[id(stage)] = _Node(len(self._nodes), stage)
        self._nodes.append(node)
        return node

    def _outputs(self, n: int) -> list[TableId]:
        return [self.create_table_id() for _ in range(n)]

    def add_algo_operator(self, stage: AlgoOperator, *inputs: TableId, outputs: int = MOST_OUTPUTS) -> list[TableId]:
        node, out = self._node(stage), self._outputs(outputs)
        node.inputs, node.outputs = [t.number for t in inputs], [t.number for t in out]
        return out

    def add_estimator(self, stage: Estimator, *fit_inputs: TableId, inputs: list[TableId] | None = None, outputs: int = MOST_OUTPUTS) -> list[TableId]:
        """``fit_inputs`` train; ``inputs`` (the same unless given) are what the fitted model transforms."""
        node, out = self._node(stage), self._outputs(outputs)
        node.fit_in, node.inputs = [t.number for t in fit_inputs], [t.number for t in (inputs if inputs is not None else fit_inputs)]
        node.outputs = [t.number for t in out]
        return out

    def set_model_data(self, stage: Stage, *tables: TableId) -> None:
        """The model data of ``stage`` (a model, or what an estimator is fitted to) comes from these tables."""
        self._made[id(stage)].model_in = [t.number for t in tables]

    def get_model_data(self, stage: Stage) -> list[TableId]:
        node = self._made[id(stage)]
        out = self._outputs(1)
        node.model_out = [t.number for t in out]
        return out

    def build_estimator(self, inputs: list[TableId], outputs: list[TableId], model_inputs: list[TableId] | None = None) -> Graph:
        return Graph(self._nodes, [t.number for t in inputs], [t.number for t in (model_inputs if model_inputs is not None else inputs)], [t.number for t in outputs])

    def build_algo_operator(self, inputs: list[TableId], outputs: list[TableId]) -> GraphModel:
        if any(n.fit_in is not None for n in self._nodes):
            raise ValueError("a graph with estimators is built with build_estimator")
        return GraphModel(self._nodes, [t.number for t in inputs], [t.number for t in outputs])

    build_model = build_algo_operator


def _execute(nodes: list[_Node], held: dict[int, DataFrame], fit: bool, spark: SparkSession) -> dict[int, Stage]:
    """Run nodes as their tables become known; returns what each has become."""
    done: dict[int, Stage] = {}
    waiting = list(nodes)
    while waiting:
        ready = [n for n in waiting if all(t in held for t in [*(n.fit_in or [] if fit else []), *n.inputs, *(n.model_in or [])])]
        if not ready:
            raise ValueError("a stage of the graph waits for a table that nothing gives")
        for n in ready:
            waiting.remove(n)
            stage = n.stage
            if isinstance(stage, Estimator) and fit:
                stage = stage.fit(*(held[t] for t in n.fit_in or []))
            if n.model_in is not None:
                stage.set_model_data(*(held[t] for t in n.model_in))
            done[n.number] = stage
            if n.inputs:
                held.update(zip(n.outputs, _tables(stage.transform(*(held[t] for t in n.inputs))), strict=False))
            if n.model_out is not None:
                held[n.model_out[0]] = stage.get_model_data(spark)
    return done


class _GraphStage(Stage):
    def _extra(self) -> dict[str, Any]:
        return {"nodes": [n.to_dict() for n in self.nodes], "ends": self.ends}

    def _save_nodes(self, spark: SparkSession, path: str) -> None:
        Stage.save(self, spark, path)
        save_stages(spark, path, [n.stage for n in self.nodes])

    @classmethod
    def _load(cls, spark: SparkSession, path: str, meta: dict[str, Any]):
        nodes = []
        for d, stage in zip(meta["nodes"], load_stages(spark, path, len(meta["nodes"])), strict=True):
            n = _Node(d["number"], stage)
            for k, v in d.items():
                setattr(n, k, v)
            nodes.append(n)
        return cls(nodes, *meta["ends"])


class Graph(_GraphStage, Estimator):
    """A graph with estimators: ``fit`` gives a graph of models."""

    def __init__(self, nodes: list[_Node], inputs: list[int], model_inputs: list[int], outputs: list[int]):
        self.nodes, self.ends = nodes, [inputs, model_inputs, outputs]
        super().__init__()

    def fit(self, *inputs: DataFrame) -> GraphModel:
        held = dict(zip(self.ends[0], inputs, strict=True))
        done = _execute(self.nodes, held, True, inputs[0].sparkSession)
        nodes = []
        for n in self.nodes:
            new = _Node(n.number, done[n.number])
            new.inputs, new.outputs, new.model_in, new.model_out = n.inputs, n.outputs, n.model_in, n.model_out
            nodes.append(new)
        return GraphModel(nodes, self.ends[1], self.ends[2])

    def save(self, spark: SparkSession, path: str) -> None:
        self._save_nodes(spark, path)


class GraphModel(_GraphStage, Model):
    def __init__(self, nodes: list[_Node], inputs: list[int], outputs: list[int]):
        self.nodes, self.ends = nodes, [inputs, outputs]
        super().__init__()

    def transform(self, *inputs: DataFrame) -> DataFrame | tuple[DataFrame, ...]:
        held = dict(zip(self.ends[0], inputs, strict=True))
        _execute(self.nodes, held, False, inputs[0].sparkSession)
        return _one(tuple(held[t] for t in self.ends[1]))

    def save(self, spark: SparkSession, path: str) -> None:
        self._save_nodes(spark, path)
