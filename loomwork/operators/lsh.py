"""MinHash locality-sensitive hashing: buckets, nearest neighbours, similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasInputCol, HasOutputCol, HasSeed, Param, gt_eq
from ..core.stage import Estimator, Model
from ..functions.hashing import JavaRandom

#: Fixed value: the prime of the hash family.
PRIME = 2038074743


class MinHashLSHModel(Model, HasInputCol, HasOutputCol):
    """Per table an array of the least ``((1+index)*a + b) % PRIME`` over the non-zero indices of a vector."""

    MODEL_SCHEMA = "numHashTables int, numHashFunctionsPerTable int, randCoefficientA array<int>, randCoefficientB array<int>"

    def _indices(self, df: DataFrame) -> Column:
        c = F.col(self.input_col)
        if V.kind(df, self.input_col) == "sparse":
            entries = F.filter(F.arrays_zip(c["indices"], c["values"]), lambda e: e["values"] != 0)
            return F.transform(entries, lambda e: e["indices"].cast("long"))
        v = V.dense(df, self.input_col)
        at = F.filter(F.transform(v, lambda x, i: F.when(x != 0, i.cast("long"))), lambda i: i.isNotNull())
        return F.when(v.isNotNull(), at)

    def _hashes(self, at: Column) -> Column:
        d = self.need()
        k, n = d["numHashFunctionsPerTable"], d["numHashTables"]
        one = lambda a, b: F.array_min(F.transform(at, lambda i: ((i + 1) * F.lit(a).cast("long") + F.lit(b).cast("long")) % PRIME)).cast("double")
        out = [one(a, b) for a, b in zip(d["randCoefficientA"], d["randCoefficientB"], strict=True)]
        return F.array(*[F.array(*out[t * k : (t + 1) * k]) for t in range(n)])

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("__at", self._indices(df))
        hashed = F.when(F.size("__at") > 0, self._hashes(F.col("__at"))).when(F.col("__at").isNotNull(), F.raise_error(F.lit("a vector needs a non-zero element")).cast("array<array<double>>"))
        return df.withColumn(self.output_col, hashed).drop("__at")

    @staticmethod
    def _jaccard(a: Column, b: Column) -> Column:
        """One minus the shared indices over all indices."""
        shared = F.size(F.array_intersect(a, b))
        return 1 - shared / (F.size(a) + F.size(b) - shared)

    def approx_nearest_neighbors(self, df: DataFrame, key: list[int], k: int, dist_col: str = "distCol") -> DataFrame:
        """The ``k`` rows nearest to the vector with non-zero ``key`` indices, among those that share a bucket with it."""
        spark = df.sparkSession
        mine = spark.range(1).select(F.array(*[F.lit(i).cast("long") for i in key]).alias("k")).select(self._hashes(F.col("k")).alias("h")).first().h
        hashed = self.transform(df).withColumn("__at", self._indices(df))
        same = F.lit(False)
        for t, bucket in enumerate(mine):
            same = same | (F.get(F.col(self.output_col), t) == F.array(*[F.lit(x) for x in bucket]))
        near = hashed.where(same).withColumn(dist_col, self._jaccard(F.col("__at"), F.array(*[F.lit(i).cast("long") for i in sorted(set(key))])))
        return near.orderBy(dist_col).limit(k).drop("__at")

    def approx_similarity_join(self, a: DataFrame, b: DataFrame, threshold: float, id_col: str, dist_col: str = "distCol") -> DataFrame:
        """Pairs of rows that share a bucket and lie within ``threshold``: ``<id>_a, <id>_b`` and the distance.

        Only ids and buckets are joined; a pair that meets in several tables is one before its vectors are compared.
        """

        def buckets(df: DataFrame, name: str) -> DataFrame:
            return self.transform(df).select(F.col(id_col).alias(name), F.posexplode(self.output_col).alias("t", "h"))

        pairs = buckets(a, "ia").join(buckets(b, "ib"), ["t", "h"]).select("ia", "ib").distinct()
        left, right = (df.select(F.col(id_col).alias(n), self._indices(df).alias(v)) for df, n, v in ((a, "ia", "va"), (b, "ib", "vb")))
        out = pairs.join(left, "ia").join(right, "ib").select(F.col("ia").alias(f"{id_col}_a"), F.col("ib").alias(f"{id_col}_b"), self._jaccard(F.col("va"), F.col("vb")).alias(dist_col))
        return out.where(F.col(dist_col) <= threshold)


class MinHashLSH(Estimator, HasInputCol, HasOutputCol, HasSeed):
    """Draws the coefficients; the data are not looked at beyond their schema."""

    num_hash_tables = Param("int", "tables", 1, gt_eq(1))
    num_hash_functions_per_table = Param("int", "hash functions per table", 1, gt_eq(1))

    def fit(self, df: DataFrame) -> MinHashLSHModel:
        rand, n = JavaRandom(self.actual_seed()), self.num_hash_tables * self.num_hash_functions_per_table
        a, b = [], []
        for _ in range(n):
            a.append(1 + rand.next_int(PRIME - 1))
            b.append(rand.next_int(PRIME - 1))
        return self.model(MinHashLSHModel(), numHashTables=self.num_hash_tables, numHashFunctionsPerTable=self.num_hash_functions_per_table, randCoefficientA=a, randCoefficientB=b)
