"""Binary classification metrics by a distributed sort and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasLabelCol, HasRawPredictionCol, HasWeightCol, Param, is_subset
from ..core.stage import AlgoOperator

#: Records of one score and weight whose precision is added up one by one; the others follow from a formula.
FEW = 64
METRICS = ("areaUnderROC", "areaUnderPR", "areaUnderLorenz", "ks")


class BinaryClassificationEvaluator(AlgoOperator, HasLabelCol, HasRawPredictionCol, HasWeightCol):
    """One row with the chosen metrics; a label of 1 is positive, and of vectors the second element is the score.

    Every record is a step of its own from high to low scores.  Records of one score are ordered by label, positives
    first, then by weight, so the result does not hang on the order of arrival.

    The sort is a range partitioning on the score.  Each partition's sums are a row; their running totals (one row per
    partition) are joined back, so no task sees more than its own range.
    """

    metrics_names = Param("strs", "which metrics", ["areaUnderROC", "areaUnderPR"], is_subset(METRICS))

    def _rows(self, df: DataFrame) -> DataFrame:
        score = F.col(self.raw_prediction_col) if V.kind(df, self.raw_prediction_col) == "number" else F.get(V.dense(df, self.raw_prediction_col), 1)
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        return df.select(score.cast("double").alias("s"), (F.col(self.label_col).cast("double") == 1.0).alias("y"), weight.alias("w"))

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self._rows(df).select("s", F.when(F.col("y"), F.col("w")).otherwise(0.0).alias("p"), F.when(F.col("y"), 0.0).otherwise(F.col("w")).alias("n"))
        # equal records are one: their steps follow each other along a line, or are counted out below
        rows = rows.groupBy("s", "p", "n").agg(F.count("*").alias("c"))
        ordered = rows.repartitionByRange(F.desc("s"), F.desc("p"), F.desc("n")).withColumn("part", F.spark_partition_id()).persist()
        order = [F.desc("s"), F.desc("p"), F.desc("n")]
        totals = ordered.groupBy("part").agg(F.sum(F.col("p") * F.col("c")).alias("tp"), F.sum(F.col("n") * F.col("c")).alias("tn"))
        ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row per partition
        offsets = totals.select("part", F.coalesce(F.sum("tp").over(ahead), F.lit(0.0)).alias("op"), F.coalesce(F.sum("tn").over(ahead), F.lit(0.0)).alias("on"))
        all_ = totals.agg(F.sum("tp").alias("all_p"), F.sum("tn").alias("all_n"))
        here = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        before = lambda x: F.coalesce(F.sum(F.col(x) * F.col("c")).over(here), F.lit(0.0))
        steps = ordered.select("*", before("p").alias("bp"), before("n").alias("bn")).join(F.broadcast(offsets), "part").join(F.broadcast(all_))
        steps = steps.select("p", "n", "c", "all_p", "all_n", (F.col("bp") + F.col("op")).alias("tp"), (F.col("bn") + F.col("on")).alias("fp"))
        return steps.agg(*[self._metric(m).alias(m) for m in self.get("metrics_names")])

    @staticmethod
    def _metric(name: str) -> Column:
        p, n, c, big_p, big_n, tp, fp = (F.col(x) for x in ("p", "n", "c", "all_p", "all_n", "tp", "fp"))
        rate = lambda x: F.when(big_p > 0, x / big_p).otherwise(1.0)
        fall = lambda x: F.when(big_n > 0, x / big_n).otherwise(1.0)
        total = big_p + big_n
        end_tp, end_fp = tp + p * c, fp + n * c
        if name == "areaUnderROC":  # c like steps make one line
            return F.sum((fall(end_fp) - fall(fp)) * (rate(end_tp) + rate(tp)) / 2)
        if name == "areaUnderLorenz":
            return F.sum((p * c + n * c) / total * (rate(end_tp) + rate(tp)) / 2)
        if name == "ks":
            return F.max(F.abs(rate(end_tp) - fall(end_fp)))
        # precision bends along a run of like records: each is a trapezoid of its own
        precision = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(1.0)
        few = F.least(c, F.lit(FEW).cast("long"))
        one = F.transform(F.sequence(F.lit(1).cast("long"), few), lambda k: (precision(tp + p * (k - 1), fp + n * (k - 1)) + precision(tp + p * k, fp + n * k)) / 2)
        # a positive record adds nothing to fp, so beyond the first ones the trapezoids of 1 - fp / (x + k p) have a closed form
        # (Euler-Maclaurin; its next term is below 1e-13 of the whole)
        low, high = tp + fp + p * few, tp + fp + p * c
        rest = (c - few) - fp * (F.log(high / low) / p + p / 12 * (1 / (low * low) - 1 / (high * high)) - p * p * p / 120 * (F.pow(low, -4) - F.pow(high, -4)))
        return F.sum(F.when((p > 0) & (big_p > 0), p / big_p * (F.aggregate(one, F.lit(0.0), lambda a, x: a + x) + F.when(c > few, rest).otherwise(0.0))).otherwise(0.0))
