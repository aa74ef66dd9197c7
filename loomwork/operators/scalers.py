"""Fitted scalers and selectors: one global aggregation, then a projection with the statistics as literals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, HasRelativeError, Param, gt_eq, in_array, in_range, not_null
from ..core.stage import Estimator, Model


def _number(x: float | None) -> float:
    return math.nan if x is None else float(x)


def accuracy(relative_error: float) -> int:
    """The accuracy of percentile_approx for a rank error."""
    return min(2**31 - 1, max(1, round(1 / relative_error) if relative_error > 0 else 2**31 - 1))


def rank(q: float, n: int) -> int:
    """The rank, from 1, of a quantile that is an element of ``n``."""
    return max(1, n - math.floor(n - q * n))


class _Scaled(Model, HasInputCol, HasOutputCol):
    """Multiplies and shifts element by element, sparse structs entry by entry where zeros stay zeros."""

    def _affine(self) -> tuple[list[float], list[float]]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        scale, shift = self._affine()
        if V.kind(df, self.input_col) == "sparse" and not any(shift):
            v, by = F.col(self.input_col), V.lit_array(scale)
            out = F.when(v.isNotNull(), F.struct(v["size"].alias("size"), v["indices"].alias("indices"), F.zip_with(v["indices"], v["values"], lambda i, x: x * F.get(by, i)).alias("values")))
            return df.withColumn(self.output_col, out)
        v = V.dense(df, self.input_col)
        if len(scale) <= V.WIDE:  # straight-line code per element, compiled with its neighbours
            out = F.array(*[F.get(v, k) * F.lit(a) + F.lit(b) if b else F.get(v, k) * F.lit(a) for k, (a, b) in enumerate(zip(scale, shift, strict=True))])
            out = F.when(F.size(v) == len(scale), out).when(v.isNotNull(), F.raise_error(F.lit(f"a vector in {self.input_col} has another size than the model")).cast("array<double>"))
        else:
            out = F.zip_with(F.zip_with(v, V.lit_array(scale), lambda x, a: x * a), V.lit_array(shift), lambda x, b: x + b)
        return df.withColumn(self.output_col, V.like(df, self.input_col, out))


class _StandardParams(HasInputCol, HasOutputCol):
    with_mean = Param("bool", "whether to subtract the mean", False)
    with_std = Param("bool", "whether to divide by the standard deviation", True)


class StandardScalerModel(_Scaled, _StandardParams):
    MODEL_SCHEMA = "mean array<double>, std array<double>, version bigint, timestamp bigint"

    def _affine(self) -> tuple[list[float], list[float]]:
        d = self.need()
        scale = [(0.0 if s == 0 else 1 / s) if self.with_std else 1.0 for s in d["std"]]
        return scale, [-m * a if self.with_mean else 0.0 for m, a in zip(d["mean"], scale, strict=True)]


class StandardScaler(Estimator, _StandardParams):
    """Sample mean and standard deviation; that of a single row is 0, and a zero deviation maps to 0."""

    def fit(self, df: DataFrame) -> StandardScalerModel:
        if V.kind(df, self.input_col) == "sparse":
            n, parts = V.sparse_moments(df, self.input_col)
            std = [math.sqrt(max(0.0, (q - a * a / n) / (n - 1))) if n > 1 else 0.0 for a, q, *_ in parts]
            return self.model(StandardScalerModel(), mean=[a / n for a, *_ in parts], std=std, version=0, timestamp=2**63 - 1)
        _, s = V.per_element(df, V.dense(df, self.input_col), {"mean": F.avg, "std": F.stddev_samp})
        return self.model(StandardScalerModel(), mean=[_number(x) for x in s["mean"]], std=[0.0 if x is None or math.isnan(x) else x for x in s["std"]], version=0, timestamp=2**63 - 1)


class _MinMaxParams(HasInputCol, HasOutputCol):
    min = Param("float", "least output", 0.0, not_null)
    max = Param("float", "greatest output", 1.0, not_null)


class MinMaxScalerModel(_Scaled, _MinMaxParams):
    MODEL_SCHEMA = "minVector array<double>, maxVector array<double>"

    def _affine(self) -> tuple[list[float], list[float]]:
        d, out = self.need(), []
        for low, high in zip(d["minVector"], d["maxVector"], strict=True):
            if abs(low - high) < 1e-5:  # a constant feature goes to the middle
                out.append((0.0, (self.max + self.min) / 2))
            else:
                scale = (self.max - self.min) / (high - low)
                out.append((scale, self.min - low * scale))
        return [a for a, _ in out], [b for _, b in out]


class MinMaxScaler(Estimator, _MinMaxParams):
    """Maps the range of each element onto [min, max]."""

    def fit(self, df: DataFrame) -> MinMaxScalerModel:
        if V.kind(df, self.input_col) == "sparse":
            _, parts = V.sparse_moments(df, self.input_col)
            return self.model(MinMaxScalerModel(), minVector=[x[2] for x in parts], maxVector=[x[3] for x in parts])
        _, s = V.per_element(df, V.dense(df, self.input_col), {"low": F.min, "high": F.max})
        return self.model(MinMaxScalerModel(), minVector=s["low"], maxVector=s["high"])


class MaxAbsScalerModel(_Scaled):
    MODEL_SCHEMA = "maxVector array<double>"

    def _affine(self) -> tuple[list[float], list[float]]:
        most = self.need()["maxVector"]
        return [1 / m if m else 0.0 for m in most], [0.0] * len(most)


class MaxAbsScaler(Estimator, HasInputCol, HasOutputCol):
    """Divides each element by its greatest magnitude; elements that are always 0 stay 0."""

    def fit(self, df: DataFrame) -> MaxAbsScalerModel:
        if V.kind(df, self.input_col) == "sparse":  # entries become rows; the vectors are not filled up
            _, parts = V.sparse_moments(df, self.input_col)
            return self.model(MaxAbsScalerModel(), maxVector=[max(-x[2], x[3]) for x in parts])
        _, s = V.per_element(df, V.dense(df, self.input_col), {"most": lambda c: F.max(F.abs(c))})
        return self.model(MaxAbsScalerModel(), maxVector=s["most"])


class _RobustParams(HasInputCol, HasOutputCol):
    with_centering = Param("bool", "whether to subtract the median", False)
    with_scaling = Param("bool", "whether to divide by the quantile range", True)


class RobustScalerModel(_Scaled, _RobustParams):
    MODEL_SCHEMA = "medians array<double>, ranges array<double>"

    def _affine(self) -> tuple[list[float], list[float]]:
        d = self.need()
        scale = [(0.0 if r == 0 else 1 / r) if self.with_scaling else 1.0 for r in d["ranges"]]
        return scale, [-m * a if self.with_centering else 0.0 for m, a in zip(d["medians"], scale, strict=True)]


class RobustScaler(Estimator, _RobustParams, HasRelativeError):
    """Median and range between two quantiles, which are elements of the data; NaN is left out."""

    lower = Param("float", "lower quantile", 0.25, in_range(0, 1, False, False))
    upper = Param("float", "upper quantile", 0.75, in_range(0, 1, False, False))

    def fit(self, df: DataFrame) -> RobustScalerModel:
        if self.lower >= self.upper:
            raise ValueError("the lower quantile must be below the upper one")
        if self.relative_error < 1 / V.SKETCH:
            got = V.order_statistics(df, V.dense(df, self.input_col), lambda n: [rank(q, n) for q in (0.5, self.lower, self.upper)])
            if not all(got):
                raise ValueError("a feature has no number")
            return self.model(RobustScalerModel(), medians=[q[0] for q in got], ranges=[q[2] - q[1] for q in got])
        at = F.array(F.lit(0.5), F.lit(self.lower), F.lit(self.upper))
        _, s = V.per_element(df, V.dense(df, self.input_col), {"q": lambda c: F.percentile_approx(F.when(~F.isnan(c), c), at, accuracy(self.relative_error))})
        if any(q is None for q in s["q"]):
            raise ValueError("a feature has no number")
        return self.model(RobustScalerModel(), medians=[q[0] for q in s["q"]], ranges=[q[2] - q[1] for q in s["q"]])


class _ImputerParams(HasInputCols, HasOutputCols):
    missing_value = Param("float", "which value is missing, besides null", math.nan)

    def _missing(self, c: Column) -> Column:
        x = c.cast("double")
        same = F.isnan(x) if self.missing_value is not None and math.isnan(self.missing_value) else x == F.lit(self.missing_value)
        return x.isNull() | same


class ImputerModel(Model, _ImputerParams):
    """Replaces missing values by their column's surrogate; the output is double."""

    MODEL_SCHEMA = "surrogates map<string,double>"

    def transform(self, df: DataFrame) -> DataFrame:
        by = self.need()["surrogates"]
        return df.withColumns({o: F.when(self._missing(F.col(c)), F.lit(by[c])).otherwise(F.col(c).cast("double")) for c, o in zip(self.get("input_cols"), self.get("output_cols"), strict=True)})


class Imputer(Estimator, _ImputerParams, HasRelativeError):
    """Mean, median or most frequent value (the smallest of several) of what is not missing, null or NaN."""

    strategy = Param("str", "mean, median or most_frequent", "mean", in_array(("mean", "median", "most_frequent")))

    def fit(self, df: DataFrame) -> ImputerModel:
        names, aggs = self.get("input_cols"), []
        if self.strategy == "median" and self.relative_error < 1 / V.SKETCH:
            cols = [F.when(~self._missing(F.col(c)), F.col(c).cast("double")) for c in names]
            got = V.order_statistics(df, F.array(*cols), lambda n: [rank(0.5, n)])
            if not all(got):
                raise ValueError(f"no value to impute from in {[c for c, x in zip(names, got, strict=True) if not x]}")
            return self.model(ImputerModel(), surrogates=dict(zip(names, (x[0] for x in got), strict=True)))
        for c in names:
            x = F.col(c).cast("double")
            there = F.when(~self._missing(F.col(c)) & ~F.isnan(x), x)
            if self.strategy == "mean":
                aggs.append(F.avg(there))
            elif self.strategy == "median":
                aggs.append(F.percentile_approx(there, F.lit(0.5), accuracy(self.relative_error)))
            else:
                aggs.append(F.mode(there, True))  # ties go to the smallest
        row = df.agg(*[a.alias(f"s{k}") for k, a in enumerate(aggs)]).first()
        if any(x is None for x in row):
            raise ValueError(f"no value to impute from in {[c for c, x in zip(names, row, strict=True) if x is None]}")
        return self.model(ImputerModel(), surrogates=dict(zip(names, map(float, row), strict=True)))


class VarianceThresholdSelectorModel(Model, HasInputCol, HasOutputCol):
    MODEL_SCHEMA = "numOfFeatures int, indices array<int>"

    def transform(self, df: DataFrame) -> DataFrame:
        v, at = V.dense(df, self.input_col), self.need()["indices"]
        return df.withColumn(self.output_col, V.like(df, self.input_col, F.when(v.isNotNull(), F.array(*[F.get(v, k) for k in at]) if at else F.array().cast("array<double>"))))


class VarianceThresholdSelector(Estimator, HasInputCol, HasOutputCol):
    """Keeps the elements whose population variance exceeds the threshold."""

    variance_threshold = Param("float", "variance to exceed", 0.0, gt_eq(0.0))

    def fit(self, df: DataFrame) -> VarianceThresholdSelectorModel:
        if V.kind(df, self.input_col) == "sparse":
            n, parts = V.sparse_moments(df, self.input_col)
            return self.model(VarianceThresholdSelectorModel(), numOfFeatures=len(parts), indices=[k for k, (a, q, *_) in enumerate(parts) if q / n - (a / n) ** 2 > self.variance_threshold])
        d, s = V.per_element(df, V.dense(df, self.input_col), {"var": F.var_pop})
        return self.model(VarianceThresholdSelectorModel(), numOfFeatures=d, indices=[k for k, x in enumerate(s["var"]) if x > self.variance_threshold])


class IDFModel(_Scaled):
    MODEL_SCHEMA = "idf array<double>, docFreq array<bigint>, numDocs bigint"

    def _affine(self) -> tuple[list[float], list[float]]:
        idf = self.need()["idf"]
        return idf, [0.0] * len(idf)


class IDF(Estimator, HasInputCol, HasOutputCol):
    """ln((m+1)/(df+1)) per element, 0 below ``min_doc_freq``; df counts the rows where it is positive."""

    min_doc_freq = Param("int", "least document frequency", 0, gt_eq(0))

    def fit(self, df: DataFrame) -> IDFModel:
        if V.kind(df, self.input_col) == "sparse":
            v = F.col(self.input_col)
            n, size = df.agg(F.count(v), F.max(v["size"])).first()
            if not n:
                raise ValueError("the training set is empty")
            freq = [0] * size
            for i, c in df.select(F.explode(F.arrays_zip(v["indices"], v["values"])).alias("e")).where("e.values > 0").groupBy("e.indices").count().collect():
                freq[i] = c
        else:
            v = V.dense(df, self.input_col)
            _, s = V.per_element(df, v, {"df": lambda c: F.sum((c > 0).cast("long")), "n": F.count})
            freq, n = s["df"], max(s["n"])
        idf = [math.log((n + 1) / (c + 1)) if c >= self.min_doc_freq else 0.0 for c in freq]
        return self.model(IDFModel(), idf=idf, docFreq=freq, numDocs=n)
