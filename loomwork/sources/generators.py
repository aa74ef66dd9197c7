"""Seeded synthetic tables: expressions over ``spark.range``, so that any number of rows is made where it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.params import HasParams, HasSeed, Param, gt, gt_eq


class Generator(HasSeed):
    num_values = Param("int", "rows", 10, gt(0))
    col_names = Param("strs2", "names of the columns")

    def names(self) -> list[str]:
        return [c for row in self.col_names or [["col0"]] for c in row]

    def column(self, k: int) -> Column:
        raise NotImplementedError

    def generate(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.num_values).select(*[self.column(k).alias(c) for k, c in enumerate(self.names())])

    def rand(self, salt: int) -> Column:
        return F.rand(self.actual_seed() * 1_000_003 + salt)


class DenseVectorGenerator(Generator):
    vector_dim = Param("int", "elements", 1, gt(0))

    def column(self, k: int) -> Column:
        return F.array(*[self.rand(k * self.vector_dim + i) for i in range(self.vector_dim)])


class DenseVectorArrayGenerator(DenseVectorGenerator):
    array_size = Param("int", "vectors per row", 1, gt(0))

    def column(self, k: int) -> Column:
        d = self.vector_dim
        return F.array(*[F.array(*[self.rand((k * self.array_size + j) * d + i) for i in range(d)]) for j in range(self.array_size)])


class DoubleGenerator(Generator):
    arity = Param("int", "distinct values; 0: any number in [0, 1)", 0, gt_eq(0))

    def column(self, k: int) -> Column:
        return F.floor(self.rand(k) * self.arity).cast("double") if self.arity else self.rand(k)


class RandomStringGenerator(Generator):
    num_distinct_values = Param("int", "distinct values", 10, gt(0))

    def column(self, k: int) -> Column:
        return F.floor(self.rand(k) * self.num_distinct_values).cast("string")


class RandomStringArrayGenerator(RandomStringGenerator):
    array_size = Param("int", "strings per row", 1, gt(0))

    def column(self, k: int) -> Column:
        return F.array(*[F.floor(self.rand(k * self.array_size + i) * self.num_distinct_values).cast("string") for i in range(self.array_size)])


class LabeledPointWithWeightGenerator(Generator):
    feature_arity = Param("int", "distinct values of a feature; 0: any number", 2, gt_eq(0))
    label_arity = Param("int", "distinct labels; 0: any number", 2, gt_eq(0))
    vector_dim = Param("int", "elements", 1, gt(0))

    def generate(self, spark: SparkSession) -> DataFrame:
        x, y, w = (self.names() + ["features", "label", "weight"])[:3] if self.col_names else ("features", "label", "weight")
        pick = lambda r, n: F.floor(r * n).cast("double") if n else r
        cols = [F.array(*[pick(self.rand(i), self.feature_arity) for i in range(self.vector_dim)]).alias(x), pick(self.rand(self.vector_dim), self.label_arity).alias(y), self.rand(self.vector_dim + 1).alias(w)]
        return spark.range(self.num_values).select(*cols)


class KMeansModelDataGenerator(HasSeed):
    vector_dim = Param("int", "elements", 1, gt(0))
    array_size = Param("int", "centroids", 2, gt(0))

    def generate(self, spark: SparkSession) -> DataFrame:
        salt = self.actual_seed() * 1_000_003
        centroids = F.array(*[F.array(*[F.rand(salt + j * self.vector_dim + i) for i in range(self.vector_dim)]) for j in range(self.array_size)])
        return spark.range(1).select(centroids.alias("centroids"), F.array(*[F.lit(1.0)] * self.array_size).alias("weights"))


GENERATORS: dict[str, type[HasParams]] = {c.__name__: c for c in (DenseVectorGenerator, DenseVectorArrayGenerator, DoubleGenerator, RandomStringGenerator, RandomStringArrayGenerator, LabeledPointWithWeightGenerator, KMeansModelDataGenerator)}


def count_and_discard(df: DataFrame) -> int:
    """Computes all rows, keeps none, and tells how many there were."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]
