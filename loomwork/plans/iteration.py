"""Bounded iteration: a loop on the driver over DataFrames that stay on the executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Round:
    """What a round gives: the next variables, whether to go on, and outputs."""

    variables: Any
    go_on: bool = True
    outputs: Any = None


@dataclass
class Listener:
    """Called at the end of every round and at the end of the loop."""

    on_round: Callable[[int, Any], None] = lambda epoch, variables: None
    on_end: Callable[[Any], None] = lambda variables: None


def max_iter(n: int) -> Callable[[int, float | None], bool]:
    """Goes on while another round would be among the first ``n``."""
    return lambda epoch, loss: epoch + 1 < n


def max_iter_or_tol(n: int, tol: float) -> Callable[[int, float | None], bool]:
    """Goes on as above while the loss exceeds ``tol``; the first round always runs."""
    return lambda epoch, loss: epoch + 1 < n and (loss is None or loss > tol)


@dataclass
class Iteration:
    """Runs ``body(epoch, variables, data)`` until it says stop.

    ``data`` are DataFrames that every round reads again: they are persisted (memory and disk) for the loop.  Variables
    that are DataFrames grow a plan with each round; every ``cut_every`` rounds they are checkpointed reliably, in the
    folder that the session names in ``spark.checkpoint.dir``.
    """

    body: Callable[[int, Any, list[DataFrame]], Round]
    listeners: list[Listener] = field(default_factory=list)
    cut_every: int = 5
    most_rounds: int = 10_000

    def run(self, variables: Any, data: list[DataFrame] | None = None) -> tuple[Any, Any]:
        held = [d.persist() for d in data or []]
        outputs = None
        try:
            for epoch in range(self.most_rounds):
                done = self.body(epoch, variables, held)
                variables, outputs = done.variables, done.outputs
                if isinstance(variables, DataFrame) and (epoch + 1) % self.cut_every == 0:
                    variables = checkpoint(variables)
                for each in self.listeners:
                    each.on_round(epoch, variables)
                if not done.go_on:
                    break
            for each in self.listeners:
                each.on_end(variables)
            return variables, outputs
        finally:
            for d in held:
                d.unpersist()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; a plain local master without one may use a temporary folder."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        wanted = sc.getConf().get("spark.checkpoint.dir")
        if not wanted and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="loomwork-iteration-"))
    return df.checkpoint()
