"""Inference without Spark: saved pipelines and logistic models over pandas frames, in one process."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd


def _metadata(path: Path) -> dict[str, Any]:
    parts = sorted(p for p in (path / "metadata").iterdir() if p.name.startswith("part-"))
    return json.loads("".join(p.read_text() for p in parts))


class TransformerServable:
    """Maps a frame to a frame."""

    def __init__(self, **params: Any):
        self.params = params

    def transform(self, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class LogisticRegressionModelServable(TransformerServable):
    """Label by the sign of the dot product, raw prediction (1-p, p), of array or sparse ``(size, indices, values)`` features."""

    DEFAULTS = {"features_col": "features", "prediction_col": "prediction", "raw_prediction_col": "raw_prediction"}

    def __init__(self, **params: Any):
        super().__init__(**{**self.DEFAULTS, **{k: v for k, v in params.items() if k in self.DEFAULTS}})
        self.coefficient: np.ndarray | None = None

    def set_model_data(self, coefficient: list[float]):
        self.coefficient = np.asarray(coefficient, float)
        return self

    def _dot(self, x: Any) -> float:
        if isinstance(x, tuple) and len(x) == 3 and np.ndim(x[1]) == 1:
            return float(np.asarray(x[2], float) @ self.coefficient[np.asarray(x[1], int)])
        return float(np.asarray(x, float) @ self.coefficient)

    def transform(self, frame: pd.DataFrame) -> pd.DataFrame:
        if self.coefficient is None:
            raise ValueError("the model has no data")
        dots = [self._dot(x) for x in frame[self.params["features_col"]]]
        out = frame.copy()
        out[self.params["prediction_col"]] = [1.0 if d >= 0 else 0.0 for d in dots]
        if self.params["raw_prediction_col"]:
            p = 1 - 1 / (1 + np.exp(np.clip(dots, -700, 700)))
            out[self.params["raw_prediction_col"]] = [[1 - x, x] for x in p]
        return out

    @classmethod
    def load(cls, path: str):
        import pyarrow.parquet as pq

        meta = _metadata(Path(path))
        data = pq.read_table(Path(path) / "data").to_pylist()[0]
        return cls(**meta["params"]).set_model_data(data["coefficient"])


#: Saved classes that can be served.
SERVABLES: dict[str, type[TransformerServable]] = {"LogisticRegressionModel": LogisticRegressionModelServable, "OnlineLogisticRegressionModel": LogisticRegressionModelServable}


class PipelineModelServable(TransformerServable):
    """The servables of a saved pipeline model, in turn; a stage that can't be served is an error at loading."""

    def __init__(self, stages: list[TransformerServable]):
        super().__init__()
        self.stages = stages

    def transform(self, frame: pd.DataFrame) -> pd.DataFrame:
        for s in self.stages:
            frame = s.transform(frame)
        return frame

    @classmethod
    def load(cls, path: str) -> PipelineModelServable:
        root, made = Path(path), []
        for k in range(_metadata(root)["stages"]):
            at = root / "stages" / f"{k:03d}"
            kind = _metadata(at)["class"]
            if kind not in SERVABLES:
                raise ValueError(f"{kind} can't be served")
            made.append(SERVABLES[kind].load(str(at)))
        return cls(made)
