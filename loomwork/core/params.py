"""Typed, validated stage parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

Check = Callable[[Any], bool]


def any_value(_: Any) -> bool:
    return True


def not_null(v: Any) -> bool:
    return v is not None


def gt(low: float) -> Check:
    return lambda v: v is not None and v > low


def gt_eq(low: float) -> Check:
    return lambda v: v is not None and v >= low


def lt(high: float) -> Check:
    return lambda v: v is not None and v < high


def lt_eq(high: float) -> Check:
    return lambda v: v is not None and v <= high


def in_range(low: float, high: float, low_in: bool = True, high_in: bool = True) -> Check:
    return lambda v: v is not None and (low <= v if low_in else low < v) and (v <= high if high_in else v < high)


def in_array(values: Iterable[Any]) -> Check:
    held = tuple(values)
    return lambda v: v in held


def non_empty(v: Any) -> bool:
    return v is not None and len(v) > 0


def is_subset(values: Iterable[Any]) -> Check:
    held = frozenset(values)
    return lambda v: v is not None and len(v) > 0 and set(v) <= held


def _float(v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float):
        raise TypeError(f"a number is wanted, not {v!r}")
    return float(v)


def _int(v: Any) -> int:
    if isinstance(v, bool) or not isinstance(v, int):
        raise TypeError(f"an integer is wanted, not {v!r}")
    return v


def _bool(v: Any) -> bool:
    if not isinstance(v, bool):
        raise TypeError(f"a boolean is wanted, not {v!r}")
    return v


def _str(v: Any) -> str:
    if not isinstance(v, str):
        raise TypeError(f"a string is wanted, not {v!r}")
    return v


def list_of(kind: Callable[[Any], Any]) -> Callable[[Any], list]:
    return lambda v: [kind(x) for x in v]


KINDS: dict[str, Callable[[Any], Any]] = {
    "bool": _bool, "int": _int, "float": _float, "str": _str, "floats": list_of(_float), "ints": list_of(_int), "strs": list_of(_str),
    "floats2": list_of(list_of(_float)), "strs2": list_of(list_of(_str)), "any": lambda v: v,
}


class Param:
    """A named parameter: its kind, default and validator.  ``None`` stands for "not set"."""

    def __init__(self, kind: str, doc: str, default: Any = None, check: Check = any_value):
        self.kind, self.doc, self.default, self.check, self.name = kind, doc, default, check, ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, obj: Any, owner: type | None = None) -> Any:
        if obj is None:
            return self
        return obj._values.get(self.name, self.default)

    def __set__(self, obj: Any, value: Any) -> None:
        obj._values[self.name] = self.valid(value)

    def valid(self, value: Any) -> Any:
        if value is not None:
            value = KINDS[self.kind](value)
        if not self.check(value):
            raise ValueError(f"parameter {self.name} can't be {value!r}: {self.doc}")
        return value


class HasParams:
    """Holds parameters declared as class attributes; keyword arguments, ``set(**values)`` and ``set_<name>`` change them."""

    def __init__(self, **values: Any):
        self._values: dict[str, Any] = {}
        self.set(**values)

    @classmethod
    def params(cls) -> dict[str, Param]:
        return {k: v for c in reversed(cls.__mro__) for k, v in vars(c).items() if isinstance(v, Param)}

    def set(self, **values: Any):
        known = self.params()
        for k, v in values.items():
            if k not in known:
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            setattr(self, k, v)
        return self

    def get(self, name: str) -> Any:
        p = self.params().get(name)
        if p is None:
            raise ValueError(f"{type(self).__name__} has no parameter {name}")
        value = getattr(self, name)
        if value is None and not p.check(None):
            raise ValueError(f"parameter {name} must be set: {p.doc}")
        return value

    def param_map(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in self.params()}

    def copy_params(self, other: HasParams) -> None:
        """Take over what ``other`` has been given of the parameters both have."""
        mine = self.params()
        self._values.update({k: v for k, v in other._values.items() if k in mine})

    def __getattr__(self, name: str) -> Any:
        m = re.fullmatch(r"(set|get)_(\w+)", name)
        if m and m[2] in type(self).params():
            return (lambda v: self.set(**{m[2]: v})) if m[1] == "set" else (lambda: self.get(m[2]))
        raise AttributeError(f"{type(self).__name__} has no attribute {name}")


class HasInputCol(HasParams):
    input_col = Param("str", "name of the input column", "input", not_null)


class HasOutputCol(HasParams):
    output_col = Param("str", "name of the output column", "output", not_null)


class HasInputCols(HasParams):
    input_cols = Param("strs", "names of the input columns", None, non_empty)


class HasOutputCols(HasParams):
    output_cols = Param("strs", "names of the output columns", None, non_empty)


class HasFeaturesCol(HasParams):
    features_col = Param("str", "name of the features column", "features", not_null)


class HasLabelCol(HasParams):
    label_col = Param("str", "name of the label column", "label", not_null)


class HasWeightCol(HasParams):
    weight_col = Param("str", "name of the weight column; all rows weigh 1 if not set")


class HasPredictionCol(HasParams):
    prediction_col = Param("str", "name of the prediction column", "prediction", not_null)


class HasRawPredictionCol(HasParams):
    raw_prediction_col = Param("str", "name of the raw prediction column", "raw_prediction")


class HasHandleInvalid(HasParams):
    handle_invalid = Param("str", "error, skip (drop the row) or keep", "error", in_array(("error", "skip", "keep")))


class HasSeed(HasParams):
    seed = Param("int", "seed of all random choices; derived from the class name if not set")

    def actual_seed(self) -> int:
        if self.seed is not None:
            return self.seed
        h = 0
        for c in type(self).__name__:
            h = (31 * h + ord(c)) & 0x7FFFFFFF
        return h


class HasDistanceMeasure(HasParams):
    distance_measure = Param("str", "euclidean, manhattan or cosine", "euclidean", in_array(("euclidean", "manhattan", "cosine")))


class HasRelativeError(HasParams):
    relative_error = Param("float", "rank error of quantiles, as a share of the rows", 0.001, in_range(0, 1))


class HasFlatten(HasParams):
    flatten = Param("bool", "one row per feature instead of one row of arrays", False)


class HasMaxIter(HasParams):
    max_iter = Param("int", "most rounds", 20, gt(0))


class HasNumFeatures(HasParams):
    num_features = Param("int", "size of the hashed feature space", 262144, gt(0))


class HasGlobalBatchSize(HasParams):
    global_batch_size = Param("int", "rows of a batch over all tasks", 32, gt(0))


class HasBatchStrategy(HasParams):
    batch_strategy = Param("str", "how online batches are cut: count", "count", in_array(("count",)))


class HasElasticNet(HasParams):
    reg = Param("float", "regularisation strength", 0.0, gt_eq(0))
    elastic_net = Param("float", "share of L1 in the regularisation", 0.0, in_range(0, 1))


class HasDecayFactor(HasParams):
    decay_factor = Param("float", "weight of what was learnt before a batch", 0.0, in_range(0, 1))


class HasModelVersion(HasParams):
    model_version_col = Param("str", "name of the model version column; none if null", "version")
    max_allowed_model_delay_ms = Param("int", "how much older than a row its model may be", 0, gt_eq(0))
