"""Tokens, n-grams, stop words and hashed features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.params import HasInputCol, HasInputCols, HasNumFeatures, HasOutputCol, HasOutputCols, Param, gt_eq, not_null
from ..core.stage import Transformer
from ..core.vectors import sparse
from ..functions.hashing import term_hashes

SPARSE = "struct<size int, indices array<int>, values array<double>>"


def _without_tail(words: Column) -> Column:
    """Without the empty strings at the end; of nothing but empty strings none is left, of the empty text one."""
    last = F.aggregate(F.transform(words, lambda w, i: F.when(w != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(words, 1, F.when((F.size(words) == 1) & (F.element_at(words, 1) == ""), 1).otherwise(last))


class Tokenizer(Transformer, HasInputCol, HasOutputCol):
    """Lower-case, cut at every white space character; empty tokens stay but for those at the end."""

    def transform(self, df: DataFrame) -> DataFrame:
        # an end without tokens is cut from the text, so that nothing has to be cut from the array
        text = F.lower(F.col(self.input_col))
        trimmed = F.regexp_replace(text, r"\s+$", "")
        out = F.when(text == "", F.array(F.lit(""))).when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s"))
        return df.withColumn(self.output_col, F.when(text.isNotNull(), out))


class RegexTokenizer(Transformer, HasInputCol, HasOutputCol):
    """Tokens between matches of a pattern (``gaps``) or the matches themselves, of a least length."""

    pattern = Param("str", "regular expression", r"\s+", not_null)
    gaps = Param("bool", "whether the pattern matches gaps", True)
    to_lowercase = Param("bool", "whether to lower-case first", True)
    min_token_length = Param("int", "least length of a token", 1, gt_eq(0))

    def transform(self, df: DataFrame) -> DataFrame:
        text = F.lower(F.col(self.input_col)) if self.to_lowercase else F.col(self.input_col)
        words = _without_tail(F.split(text, self.pattern)) if self.gaps else F.regexp_extract_all(text, F.lit(self.pattern), 0)
        if self.min_token_length > 0:
            words = F.filter(words, lambda w: F.char_length(w) >= self.min_token_length)
        return df.withColumn(self.output_col, words)


class NGram(Transformer, HasInputCol, HasOutputCol):
    """Runs of n tokens, joined by spaces; none if there are fewer tokens."""

    n = Param("int", "tokens per gram", 2, gt_eq(1))

    def transform(self, df: DataFrame) -> DataFrame:
        words, n = F.col(self.input_col), self.n
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return df.withColumn(self.output_col, F.when(F.size(words) >= n, grams).when(words.isNotNull(), F.array().cast("array<string>")))


class StopWordsRemover(Transformer, HasInputCols, HasOutputCols):
    """Drops stop words; null tokens stay unless the list holds null.  The lists ship with Spark."""

    stop_words = Param("any", "words to drop; the English list if not set", None, lambda v: v is None or len(v) > 0)
    case_sensitive = Param("bool", "whether case counts", False)
    locale = Param("str", "language whose rules lower-case the words", "en_US", not_null)

    @staticmethod
    def load_default_stop_words(language: str) -> list[str]:
        from pyspark.ml.feature import StopWordsRemover as Native

        return Native.loadDefaultStopWords(language)

    def _lower(self, c: Column) -> Column:
        if self.locale.split("_")[0] in ("tr", "az"):  # dotted and dotless i
            return F.lower(F.regexp_replace(F.regexp_replace(c, "I", "ı"), "İ", "i"))
        return F.lower(c)

    def transform(self, df: DataFrame) -> DataFrame:
        stop = self.stop_words if self.stop_words is not None else self.load_default_stop_words("english")
        words = F.array(*[F.lit(w) for w in sorted({w for w in stop if w is not None})]).cast("array<string>")
        words = words if self.case_sensitive else F.transform(words, self._lower)
        held = lambda t: F.coalesce(F.array_contains(words, t if self.case_sensitive else self._lower(t)), F.lit(None in stop))
        return df.withColumns({o: F.filter(F.col(c), lambda t: ~held(t)) for c, o in zip(self.get("input_cols"), self.get("output_cols"), strict=True)})


class HashingTF(Transformer, HasInputCol, HasOutputCol, HasNumFeatures):
    """Term frequencies in a hashed space: murmur3 of a term, its non-negative remainder the index."""

    binary = Param("bool", "whether every frequency is 1", False)

    def transform(self, df: DataFrame) -> DataFrame:
        n, binary, element = self.num_features, self.binary, df.schema[self.input_col].dataType
        if not isinstance(element, T.ArrayType):
            raise TypeError(f"column {self.input_col} holds no arrays")
        width = 4 if isinstance(element.elementType, T.IntegerType | T.ShortType | T.ByteType) else 8

        @F.arrow_udf(SPARSE)
        def hashed(docs: pa.Array) -> pa.Array:
            return joined([piece(part) for part in slices(docs)])

        def piece(docs: pa.Array) -> pa.Array:
            docs = docs.cast(pa.list_(docs.type.value_type))
            terms = docs.flatten().dictionary_encode()  # each distinct term of the batch is hashed once
            held = term_hashes(terms.dictionary.to_pylist(), width) if len(terms) else np.zeros(0, np.int64)
            places = np.append(np.mod(held, n), 0)  # the last for a null term
            at = terms.indices.fill_null(len(held)).to_numpy(zero_copy_only=False)
            return counted(docs, places[at], n, binary)

        return df.withColumn(self.output_col, F.when(F.col(self.input_col).isNotNull(), hashed(F.col(self.input_col))))


_TOKENS = 200_000  # tokens that are counted at once, unless one row has more


def slices(docs: pa.Array) -> Iterator[pa.Array]:
    """The lists in order, cut where their elements would be more than _TOKENS; the memory of counting is that of a piece."""
    ends = np.cumsum(pc.list_value_length(docs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(docs):
        below = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, below + _TOKENS, side="right")))
        yield docs.slice(at, end - at)
        at = end


def joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))


def counted(docs: pa.Array, index: np.ndarray, size: int, binary: bool, least: np.ndarray | None = None) -> pa.Array:
    """Sparse counts per row of the ``index`` of every element of the lists, end to end; negative ones are left out.

    ``least`` are the counts below which an index of a row is dropped.
    """
    lengths = pc.list_value_length(docs).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(docs)), lengths)
    there = index >= 0
    key, n = np.unique(row[there] * np.int64(size) + index[there], return_counts=True)
    row = key // size
    if least is not None:
        kept = n >= least[row]
        key, n, row = key[kept], n[kept], row[kept]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(docs)))]).astype(np.int32))
    values = np.ones(len(key)) if binary else n.astype(float)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key % size).astype(np.int32), values)]
    return pa.StructArray.from_arrays([pa.array(np.full(len(docs), size, np.int32)), *lists], names=["size", "indices", "values"])


class FeatureHasher(Transformer, HasInputCols, HasOutputCol, HasNumFeatures):
    """Columns hashed into one vector: numbers under their column's name, categories as 1 under ``column=value``; nulls are left out.

    Boolean and string columns are categories, and those named in ``categorical_cols``.
    """

    categorical_cols = Param("strs", "number columns to take as categories", [], not_null)

    def transform(self, df: DataFrame) -> DataFrame:
        n, names = self.num_features, self.get("input_cols")
        unknown = set(self.categorical_cols) - set(names)
        if unknown:
            raise ValueError(f"categorical columns that are no inputs: {sorted(unknown)}")
        parts = []
        for c in names:
            t = df.schema[c].dataType
            if c in self.categorical_cols or isinstance(t, T.StringType | T.BooleanType):
                parts.append(F.when(F.col(c).isNotNull(), F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("key"), F.lit(1.0).alias("value"))))
            else:
                parts.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))))
        entries = F.array_compact(F.array(*parts))

        @F.pandas_udf("array<int>")
        def places(keys: pd.Series) -> pd.Series:
            kinds = list({k for row in keys for k in row})
            index = dict(zip(kinds, np.mod(np.abs(term_hashes(kinds)), n).tolist(), strict=True))
            return pd.Series([[index[k] for k in row] for row in keys])

        tmp = "__hashed"
        df = df.withColumn(tmp, entries)
        at = places(F.transform(F.col(tmp), lambda e: e["key"]))
        df = df.withColumn("__at", at)
        pairs = F.zip_with(F.col("__at"), F.col(tmp), lambda i, e: F.struct(i.alias("index"), e["value"].alias("value")))
        summed = F.transform(F.array_sort(F.array_distinct(F.col("__at"))), lambda i: F.struct(i.alias("index"), F.aggregate(F.filter(pairs, lambda p: p["index"] == i), F.lit(0.0), lambda a, p: a + p["value"]).alias("value")))
        return df.withColumn(self.output_col, sparse(n, summed)).drop(tmp, "__at")
