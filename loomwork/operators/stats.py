"""Tests of independence and the selection of features by them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasFeaturesCol, HasFlatten, HasLabelCol, HasOutputCol, Param, in_array
from ..core.stage import AlgoOperator, Estimator, Model
from ..functions.tails import chi_square, f_tail


class _Test(AlgoOperator, HasFeaturesCol, HasLabelCol, HasFlatten):
    """Rows of (p value, degrees of freedom, statistic) per feature; a few numbers per feature reach the driver."""

    NAMES = ("pValue", "degreeOfFreedom", "statistic")
    PLURAL = ("pValues", "degreesOfFreedom", "statistics")
    INTEGER_DOF = "bigint"

    def results(self, df: DataFrame) -> list[tuple[float, int, float]]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        rows, spark = self.results(df), df.sparkSession
        p, n, s = self.NAMES
        if self.flatten:
            return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"featureIndex int, {p} double, {n} bigint, {s} double")
        ps, ns, ss = self.PLURAL
        return spark.createDataFrame([tuple([r[i] for r in rows] for i in range(3))], f"{ps} array<double>, {ns} array<bigint>, {ss} array<double>")


def _half_up(x: float) -> float:
    """To 11 decimals, halves away from zero."""
    if math.isnan(x) or math.isinf(x):
        return x
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("1e-11"), ROUND_HALF_UP))


class ChiSqTest(_Test):
    """Pearson's test of each feature against the label, both categorical."""

    def contingency(self, df: DataFrame) -> DataFrame:
        """``i, v, l, n``: rows of each feature's value with each label, combined before the shuffle."""
        v = V.dense(df, self.features_col)
        rows = df.select(F.col(self.label_col).cast("double").alias("l"), F.posexplode(v).alias("i", "v"))
        return rows.groupBy("i", "v", "l").agg(F.count("*").alias("n"))

    def statistics(self, df: DataFrame) -> DataFrame:
        """``i, statistic, dof`` by joins of the observed counts with their margins.

        The sum of (o-e)^2/e over all cells is the sum of o^2/e over those observed, less the number of rows.
        """
        cells = self.contingency(df).persist()
        of_value = cells.groupBy("i", "v").agg(F.sum("n").alias("nv"))
        of_label = cells.groupBy("i", "l").agg(F.sum("n").alias("nl"))
        all_ = cells.groupBy("i").agg(F.sum("n").alias("total"), F.countDistinct("v").alias("kv"), F.countDistinct("l").alias("kl"))
        met = cells.join(of_value, ["i", "v"]).join(of_label, ["i", "l"]).join(all_, "i")
        return met.groupBy("i").agg((F.sum(F.col("n") * F.col("n") / (F.col("nv") * F.col("nl") / F.col("total"))) - F.max("total")).alias("statistic"), ((F.max("kv") - 1) * (F.max("kl") - 1)).alias("dof"))

    def results(self, df: DataFrame) -> list[tuple[float, int, float]]:
        out = []
        for _, stat, dof in sorted(map(tuple, self.statistics(df).collect())):
            stat = 0.0 if dof == 0 else max(stat, 0.0)
            out.append((_half_up(chi_square(stat, dof) if dof else 1.0), int(dof), _half_up(stat)))
        return out


class ANOVATest(_Test):
    """F test of a continuous feature against a categorical label; the degrees of freedom are those between and within."""

    NAMES = ("pValue", "degreeOfFreedom", "fValue")
    PLURAL = ("pValues", "degreesOfFreedom", "fValues")

    def groups(self, df: DataFrame) -> DataFrame:
        """``i, l, n, s, q``: count, sum and sum of squares of each feature under each label."""
        rows = df.select(F.col(self.label_col).cast("double").alias("l"), F.posexplode(V.dense(df, self.features_col)).alias("i", "x"))
        return rows.groupBy("i", "l").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))

    def statistics(self, df: DataFrame) -> DataFrame:
        """``i, f, between, within`` in closed form."""
        g = self.groups(df).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
        mean = F.col("s") * F.col("s") / F.col("n")
        between, within = F.col("b") - mean, F.col("q") - F.col("b")
        d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
        return g.select("i", F.try_divide(between / F.nullif(d1, F.lit(0)), within / F.nullif(d2, F.lit(0))).alias("f"), d1.alias("d1"), d2.alias("d2"), between.alias("between"), within.alias("within"))

    def results(self, df: DataFrame) -> list[tuple[float, int, float]]:
        out = []
        for r in sorted(self.statistics(df).collect(), key=lambda r: r.i):
            f = r.f if r.f is not None else (math.nan if not r.between or math.isnan(r.between) else math.inf)
            out.append((f_tail(f, r.d1, r.d2), int(r.d1 + r.d2), f))
        return out


class FValueTest(_Test):
    """F test of the correlation of a continuous feature with a continuous label."""

    NAMES = ("pValue", "degreeOfFreedom", "fValue")
    PLURAL = ("pValues", "degreesOfFreedom", "fValues")

    def statistics(self, df: DataFrame) -> DataFrame:
        """``i, r, n``: Pearson correlation and row count."""
        rows = df.select(F.col(self.label_col).cast("double").alias("y"), F.posexplode(V.dense(df, self.features_col)).alias("i", "x"))
        return rows.groupBy("i").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))

    def results(self, df: DataFrame) -> list[tuple[float, int, float]]:
        out = []
        for _, r, n in sorted(((t.i, t.r, t.n) for t in self.statistics(df).collect()), key=lambda t: t[0]):
            r = math.nan if r is None else r
            f = math.inf if r * r >= 1 else r * r / (1 - r * r) * (n - 2)
            out.append((f_tail(f, 1, n - 2), n - 2, f))
        return out


class UnivariateFeatureSelectorModel(Model, HasFeaturesCol, HasOutputCol):
    MODEL_SCHEMA = "indices array<int>"

    def transform(self, df: DataFrame) -> DataFrame:
        v, at = V.dense(df, self.features_col), self.need()["indices"]
        return df.withColumn(self.output_col, V.like(df, self.features_col, F.when(v.isNotNull(), F.array(*[F.get(v, k) for k in at]) if at else F.array().cast("array<double>"))))


class UnivariateFeatureSelector(Estimator, HasFeaturesCol, HasLabelCol, HasOutputCol):
    """Keeps features by the p value of the test that their and the label's type call for."""

    feature_type = Param("str", "categorical or continuous", None, in_array(("categorical", "continuous")))
    label_type = Param("str", "categorical or continuous", None, in_array(("categorical", "continuous")))
    selection_mode = Param("str", "numTopFeatures, percentile, fpr, fdr or fwe", "numTopFeatures", in_array(("numTopFeatures", "percentile", "fpr", "fdr", "fwe")))
    selection_threshold = Param("float", "bound of the mode; 50, 0.1 or 0.05 if not set")

    def _chosen(self, p: list[float]) -> list[int]:
        mode = self.selection_mode
        bound = self.selection_threshold if self.selection_threshold is not None else {"numTopFeatures": 50, "percentile": 0.1}.get(mode, 0.05)
        order = sorted(range(len(p)), key=lambda k: (math.inf if math.isnan(p[k]) else p[k], k))
        if mode == "numTopFeatures":
            return order[: int(bound)]
        if mode == "percentile":
            return order[: int(len(p) * bound)]
        if mode == "fpr":
            return [k for k in order if p[k] < bound]
        if mode == "fwe":
            return [k for k in order if p[k] < bound / len(p)]
        last = max((r for r, k in enumerate(order) if p[k] < bound / len(p) * (r + 1)), default=-1)
        return order[: last + 1]

    def fit(self, df: DataFrame) -> UnivariateFeatureSelectorModel:
        kinds = (self.get("feature_type"), self.get("label_type"))
        tests = {("categorical", "categorical"): ChiSqTest, ("continuous", "categorical"): ANOVATest, ("continuous", "continuous"): FValueTest}
        if kinds not in tests:
            raise ValueError("categorical features of a continuous label have no test")
        made = tests[kinds](features_col=self.features_col, label_col=self.label_col)
        return self.model(UnivariateFeatureSelectorModel(), indices=sorted(self._chosen([r[0] for r in made.results(df)])))
