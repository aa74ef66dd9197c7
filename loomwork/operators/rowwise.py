"""Stateless row operators: projections that Catalyst collapses with their neighbours."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vectors as V
from ..core.params import HasHandleInvalid, HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, HasSeed, Param, gt_eq, non_empty, not_null
from ..core.stage import AlgoOperator, Transformer
from ..functions.distance import norm


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


class Binarizer(Transformer, HasInputCols, HasOutputCols):
    """1 where a number exceeds its column's threshold, else 0.  Of sparse vectors only stored entries are looked at."""

    thresholds = Param("floats", "one threshold per input column", None, non_empty)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, o, t in zip(self.get("input_cols"), self.get("output_cols"), self.get("thresholds"), strict=True):
            cols[o] = self._column(df, c, t)
        return df.withColumns(cols)

    @staticmethod
    def _column(df: DataFrame, c: str, t: float) -> Column:
        kind = V.kind(df, c)
        if kind == "number":
            return F.when(F.col(c).isNotNull(), F.when(F.col(c).cast("double") > t, 1.0).otherwise(0.0))
        if kind == "sparse":
            v = F.col(c)
            entries = F.filter(F.arrays_zip(v["indices"], v["values"]), lambda e: e["values"] > t)
            return F.when(v.isNotNull(), F.struct(v["size"].alias("size"), F.transform(entries, lambda e: e["indices"]).alias("indices"), F.transform(entries, lambda e: F.lit(1.0)).alias("values")))
        return V.like(df, c, F.transform(V.dense(df, c), lambda x: F.when(x > t, 1.0).otherwise(0.0)))


class Bucketizer(Transformer, HasInputCols, HasOutputCols, HasHandleInvalid):
    """Index of the bucket [s_i, s_i+1) a number falls in; the last bucket is closed.

    NaN, null and numbers out of range are invalid: an error, a dropped row, or the extra bucket after the last.
    """

    splits_array = Param("floats2", "ascending splits per input column, three at least", None, lambda v: v is not None and len(v) > 0 and all(len(s) >= 3 and all(a < b for a, b in zip(s, s[1:], strict=False)) for s in v))

    def transform(self, df: DataFrame) -> DataFrame:
        cols, valid = {}, []
        for c, o, s in zip(self.get("input_cols"), self.get("output_cols"), self.get("splits_array"), strict=True):
            x = F.col(c).cast("double")
            ok = x.isNotNull() & ~F.isnan(x) & (x >= s[0]) & (x <= s[-1])
            index = F.lit(float(len(s) - 2))
            for k in range(len(s) - 3, -1, -1):
                index = F.when(x < s[k + 1], float(k)).otherwise(index)
            other = F.lit(float(len(s) - 1)) if self.handle_invalid == "keep" else _fail(f"{c}: a value is out of its splits or NaN").cast("double") if self.handle_invalid == "error" else F.lit(None).cast("double")
            cols[o] = F.when(ok, index).otherwise(other)
            valid.append(ok)
        if self.handle_invalid == "skip":
            df = df.where(reduce(lambda a, b: a & b, valid))
        return df.withColumns(cols)


class VectorAssembler(Transformer, HasInputCols, HasOutputCol, HasHandleInvalid):
    """Numbers and vectors end to end.  Null, NaN and, unless kept, a wrong size are invalid; kept ones become NaN."""

    input_sizes = Param("ints", "size of each input column", None, lambda v: v is None or (len(v) > 0 and all(x > 0 for x in v)))

    def transform(self, df: DataFrame) -> DataFrame:
        names = self.get("input_cols")
        sizes = self.input_sizes or [None] * len(names)
        if len(sizes) != len(names):
            raise ValueError("one size per input column is wanted")
        parts, valid, run = [], [], []
        for c, n in zip(names, sizes, strict=True):
            if V.kind(df, c) == "number" and n in (None, 1):  # numbers side by side are one compiled array
                x = F.col(c).cast("double")
                run.append(F.coalesce(x, F.lit(math.nan)))
                valid.append(x.isNotNull() & ~F.isnan(x))
                continue
            if run:
                parts.append(F.array(*run))
                run = []
            v = V.dense(df, c)
            sized = (F.size(v) == n) if n is not None else F.lit(True)
            parts.append(F.when(F.col(c).isNotNull() & sized, F.transform(v, lambda x: F.coalesce(x, F.lit(math.nan)))).otherwise(F.array_repeat(F.lit(math.nan), n or 1)))
            valid.append(F.coalesce(F.col(c).isNotNull() & sized & ~F.exists(v, lambda x: F.isnan(x) | x.isNull()), F.lit(False)))
        if run:
            parts.append(F.array(*run))
        good = reduce(lambda a, b: a & b, valid)
        out = F.concat(*parts) if len(parts) > 1 else parts[0]
        if self.handle_invalid == "skip":
            df = df.where(good)
        elif self.handle_invalid == "error":
            out = F.when(good, out).otherwise(_fail("an input to be assembled is null, NaN or of another size").cast("array<double>"))
        return df.withColumn(self.output_col, out)


class VectorSlicer(Transformer, HasInputCol, HasOutputCol):
    """The elements at the given indices, in their order; an index beyond the vector is an error."""

    indices = Param("ints", "distinct indices from 0", None, lambda v: v is not None and len(v) > 0 and min(v) >= 0 and len(set(v)) == len(v))

    def transform(self, df: DataFrame) -> DataFrame:
        at, v = self.get("indices"), V.dense(df, self.input_col)
        out = F.array(*[F.get(v, i) for i in at])
        out = F.when(F.size(v) > max(at), out).when(v.isNotNull(), _fail(f"an index is beyond the vector in {self.input_col}").cast("array<double>"))
        return df.withColumn(self.output_col, V.like(df, self.input_col, out))


class ElementwiseProduct(Transformer, HasInputCol, HasOutputCol):
    """Product with a constant vector, element by element; null stays null, another size is an error."""

    scaling_vec = Param("floats", "the vector to multiply by", None, not_null)

    def transform(self, df: DataFrame) -> DataFrame:
        by = V.lit_array(self.get("scaling_vec"))
        n = len(self.scaling_vec)
        if V.kind(df, self.input_col) == "sparse":
            v = F.col(self.input_col)
            out = F.when(v["size"] == n, F.struct(v["size"].alias("size"), v["indices"].alias("indices"), F.zip_with(v["indices"], v["values"], lambda i, x: x * F.get(by, i)).alias("values")))
            return df.withColumn(self.output_col, F.when(v.isNull() | (v["size"] == n), out).otherwise(_fail("vector sizes differ").cast(df.schema[self.input_col].dataType)))
        v = V.dense(df, self.input_col)
        out = F.when(v.isNull(), F.lit(None)).when(F.size(v) == n, F.zip_with(v, by, lambda x, y: x * y)).otherwise(_fail("vector sizes differ").cast("array<double>"))
        return df.withColumn(self.output_col, V.like(df, self.input_col, out))


class Interaction(Transformer, HasInputCols, HasOutputCol):
    """Products of one element of each column; the first column varies slowest.  Any null gives null."""

    def transform(self, df: DataFrame) -> DataFrame:
        out = None
        for c in self.get("input_cols"):
            v = V.dense(df, c)
            out = v if out is None else self._outer(out, v)
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.input_cols])
        return df.withColumn(self.output_col, F.when(~null, out))

    @staticmethod
    def _outer(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


class PolynomialExpansion(Transformer, HasInputCol, HasOutputCol):
    """All monomials of degree 1 to ``degree``: those without the last element first, then those with ever higher powers of it."""

    degree = Param("int", "highest degree", 2, gt_eq(1))

    @staticmethod
    def monomials(n: int, degree: int) -> list[tuple[int, ...]]:
        """Elements of each monomial in order, without the constant."""
        made = [m for d in range(1, degree + 1) for m in combinations_with_replacement(range(n), d)]
        return sorted(made, key=lambda m: tuple(m.count(k) for k in range(n - 1, -1, -1)))

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import PolynomialExpansion as Native
        from pyspark.ml.functions import array_to_vector, vector_to_array

        v = V.dense(df, self.input_col)
        tmp_in, tmp_out = "__expand_in", "__expand_out"
        made = Native(degree=self.degree, inputCol=tmp_in, outputCol=tmp_out).transform(df.withColumn(tmp_in, array_to_vector(v)))
        out = F.col(tmp_out) if V.kind(df, self.input_col) == "vector" else vector_to_array(F.col(tmp_out))
        return made.withColumn(self.output_col, out).drop(tmp_in, tmp_out)


class Normalizer(Transformer, HasInputCol, HasOutputCol):
    """The vector divided by its p-norm; a zero vector becomes NaN."""

    p = Param("float", "which norm, 1 at least", 2.0, gt_eq(1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        scale = lambda v: F.coalesce(F.try_divide(F.lit(1.0), norm(v, self.p)), F.lit(math.inf))
        if V.kind(df, self.input_col) == "sparse":
            v = F.col(self.input_col)
            by = F.struct(v["values"].alias("v"), scale(v["values"]).alias("s"))
            values = F.get(F.transform(F.array(by), lambda b: F.transform(b["v"], lambda x: x * b["s"])), 0)
            return df.withColumn(self.output_col, F.when(v.isNotNull(), F.struct(v["size"].alias("size"), v["indices"].alias("indices"), values.alias("values"))))
        v = V.dense(df, self.input_col)
        # the norm is bound once by the outer lambda instead of being computed for every element
        out = F.get(F.transform(F.array(F.struct(v.alias("v"), scale(v).alias("s"))), lambda b: F.transform(b["v"], lambda x: x * b["s"])), 0)
        return df.withColumn(self.output_col, V.like(df, self.input_col, F.when(v.isNotNull(), out)))


class DCT(Transformer, HasInputCol, HasOutputCol):
    """Orthonormal discrete cosine transform (type II), or its inverse."""

    inverse = Param("bool", "whether to invert", False)

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import DCT as Native
        from pyspark.ml.functions import array_to_vector, vector_to_array

        tmp_in, tmp_out = "__dct_in", "__dct_out"
        made = Native(inverse=self.inverse, inputCol=tmp_in, outputCol=tmp_out).transform(df.withColumn(tmp_in, array_to_vector(V.dense(df, self.input_col))))
        out = F.col(tmp_out) if V.kind(df, self.input_col) == "vector" else vector_to_array(F.col(tmp_out))
        return made.withColumn(self.output_col, out).drop(tmp_in, tmp_out)


class SQLTransformer(Transformer):
    """Runs a statement in which ``__THIS__`` names the input; Catalyst sees it as any other query."""

    statement = Param("str", "SQL with __THIS__ for the input table", None, lambda v: v is not None and "__THIS__" in v)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.sql(self.get("statement").replace("__THIS__", "{__this__}"), __this__=df)


class RandomSplitter(AlgoOperator, HasSeed):
    """Splits rows at random by weights; one seeded draw per row decides, so the parts are disjoint and complete."""

    weights = Param("floats", "weight of each part", [1.0, 1.0], lambda v: v is not None and len(v) > 1 and all(x > 0 for x in v))

    def transform(self, df: DataFrame) -> tuple[DataFrame, ...]:
        return tuple(df.randomSplit(self.get("weights"), self.actual_seed()))
