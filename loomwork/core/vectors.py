"""Vector columns: ML vectors, arrays of numbers, or sparse structs ``struct<size int, indices array<int>, values array<double>>``."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this dimension on, statistics go through exploded rows instead of one expression per element.
WIDE = 128


def kind(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    if isinstance(t, VectorUDT):
        return "vector"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.StructType) and {"size", "indices", "values"} <= set(t.names):
        return "sparse"
    if isinstance(t, T.NumericType | T.BooleanType):
        return "number"
    return "other"


def densify(c: Column) -> Column:
    """The array of a sparse struct."""
    filled = F.map_from_arrays(c["indices"], c["values"])
    return F.when(c.isNotNull(), F.when(c["size"] > 0, F.transform(F.sequence(F.lit(0), c["size"] - 1), lambda i: F.coalesce(F.element_at(filled, i), F.lit(0.0)))).otherwise(F.array().cast("array<double>")))


def dense(df: DataFrame, name: str) -> Column:
    """The column as ``array<double>``."""
    k = kind(df, name)
    if k == "vector":
        return vector_to_array(F.col(name))
    if k == "array":
        return F.col(name).cast("array<double>")
    if k == "sparse":
        return densify(F.col(name))
    if k == "number":
        return F.array(F.col(name).cast("double"))
    raise TypeError(f"column {name} is no vector")


def like(df: DataFrame, name: str, c: Column) -> Column:
    """An ``array<double>`` in the representation of column ``name`` (an array, unless that holds ML vectors)."""
    return array_to_vector(c) if kind(df, name) == "vector" else c


def sparse(size: Column | int, entries: Column) -> Column:
    """A sparse struct from ``array<struct<index, value>>``, sorted by index; null entries give null."""
    e = F.array_sort(entries)
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(entries.isNotNull(), F.struct(size.cast("int").alias("size"), F.transform(e, lambda x: x["index"].cast("int")).alias("indices"), F.transform(e, lambda x: x["value"].cast("double")).alias("values")))


def dimension(df: DataFrame, v: Column) -> int:
    """The one size of all vectors; an error if there is no row or the sizes differ."""
    low, high = df.agg(F.min(F.size(v)), F.max(F.size(v))).first()
    if low is None:
        raise ValueError("the training set is empty")
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} elements")
    return low


def per_element(df: DataFrame, v: Column, aggs: dict) -> tuple[int, dict[str, list]]:
    """Aggregates of each element: ``aggs`` maps a name to a function from a column to an aggregate.

    Up to WIDE elements are one row of partial and final hash aggregates; beyond, elements become rows keyed by their
    place, which shuffles one partial row per place and task.
    """
    d = dimension(df, v)
    if d == 0:
        return 0, {k: [] for k in aggs}
    if d <= WIDE:
        row = df.select(v.alias("_v")).agg(*[f(F.col("_v")[i]).alias(f"{k}_{i}") for k, f in aggs.items() for i in range(d)]).first()
        return d, {k: [row[f"{k}_{i}"] for i in range(d)] for k in aggs}
    rows = df.select(F.posexplode(v).alias("_i", "_x")).groupBy("_i").agg(*[f(F.col("_x")).alias(k) for k, f in aggs.items()]).orderBy("_i").collect()
    return d, {k: [r[k] for r in rows] for k in aggs}


#: Accuracy of the sketch that brackets an order statistic, rows of a bracket that are ranked at once, ranks of one pass.
SKETCH, FEW_ROWS, AT_ONCE = 10_000, 100_000, 64


def order_statistics(df: DataFrame, v: Column, ranks: Callable[[int], list[int]]) -> list[list[float]]:
    """Exact order statistics of each element, NaN left out; ``ranks`` maps a count of numbers to ranks from 1.

    A small sketch brackets each rank, one pass counts the rows below and inside, and so on until few rows or values are
    inside.  A sketch that errs costs passes, not the result.  No more than FEW_ROWS values of a rank reach the driver.
    """
    there = lambda c: F.when(~F.isnan(c), c)
    d, s = per_element(df, v, {"n": lambda c: F.count(there(c)), "low": lambda c: F.min(there(c)), "high": lambda c: F.max(there(c))})
    asked = [ranks(n) if n else [] for n in s["n"]]
    #: of each (place, rank): least and greatest value it can be, rows below, rows inside
    known = {(k, r): (s["low"][k] + 0.0, s["high"][k] + 0.0, 0, s["n"][k]) for k in range(d) for r in asked[k]}
    rows = df.select(v.alias("_v"))
    x = lambda k: F.get(F.col("_v"), k)
    inside = lambda key, low, high: (x(key[0]) >= low) & (x(key[0]) <= high)
    while open_ := [key for key, (low, high, *_) in known.items() if low < high][:AT_ONCE]:
        aggs, ranked = [], [key for key in open_ if known[key][3] <= FEW_ROWS]
        if not ranked:
            # ranks of one bracket, all of an element's at first, share a sketch
            shared: dict[tuple, list[tuple[int, int]]] = {}
            for key in open_:
                shared.setdefault((key[0], known[key]), []).append(key)
            for j, ((k, (low, high, below, n)), keys) in enumerate(shared.items()):
                at = [e for key in keys for e in (max(0.0, (key[1] - below) / n - 2 / SKETCH), min(1.0, (key[1] - below) / n + 2 / SKETCH))]
                aggs.append(F.percentile_approx(F.when(inside((k, 0), low, high), x(k)), F.array(*map(F.lit, at)), SKETCH).alias(f"q{j}"))
            row = rows.agg(*aggs).first()
            tried = {key: tuple(row[f"q{j}"][2 * i : 2 * i + 2]) for j, keys in enumerate(shared.values()) for i, key in enumerate(keys)}
            for key, held in _counted(rows, tried, inside, x).items():
                if held[2] < key[1] <= held[2] + held[3] and held[3] <= known[key][3] // 2 or held[0] == held[1] and held[2] < key[1] <= held[2] + held[3]:
                    known[key] = held
                else:
                    ranked.append(key)
        # few rows, or a bracket that does not shrink, as between two values of many rows each
        cells = F.array_compact(F.array(*[F.when(inside(key, *known[key][:2]), F.struct(F.lit(j).alias("j"), (x(key[0]) + 0.0).alias("x"))) for j, key in enumerate(ranked)])) if ranked else None
        if ranked:
            kinds = rows.where(reduce(or_, [inside(key, *known[key][:2]) for key in ranked])).select(F.explode(cells).alias("e")).groupBy("e.j", "e.x").count().persist()
            few = {r.j for r in kinds.groupBy("j").count().where(F.col("count") <= FEW_ROWS).collect()}
            got: dict[int, list[tuple[float, int]]] = {}
            for j, value, n in kinds.where(F.col("j").isin(*few)).collect() if few else []:
                got.setdefault(j, []).append((value, n))
            kinds.unpersist()
            halves = {}
            for j, key in enumerate(ranked):
                low, high, below, _ = known[key]
                if j not in got:  # too many values still: halve
                    halves[key] = (low, low / 2 + high / 2)
                    continue
                for value, n in sorted(got[j]):
                    below += n
                    if below >= key[1]:
                        known[key] = (value, value, below - n, n)
                        break
            for key, held in _counted(rows, halves, inside, x).items() if halves else ():
                low, high, below, n = known[key]
                upto = held[2] + held[3]
                known[key] = held if key[1] <= upto else (math.nextafter(held[1], math.inf), high, upto, n - held[3])
    return [[known[k, r][0] for r in asked[k]] for k in range(d)]


def _counted(rows: DataFrame, brackets: dict, inside: Callable, x: Callable) -> dict:
    """Each bracket with the rows below and inside."""
    row = rows.agg(*[e for j, (key, (low, high)) in enumerate(brackets.items()) for e in (F.sum((x(key[0]) < low).cast("long")).alias(f"b{j}"), F.sum(inside(key, low, high).cast("long")).alias(f"n{j}"))]).first()
    return {key: (*brackets[key], row[f"b{j}"], row[f"n{j}"]) for j, key in enumerate(brackets)}


def sparse_moments(df: DataFrame, name: str) -> tuple[int, list[tuple[float, float, float, float]]]:
    """Row count, and (sum, sum of squares, least, greatest) of each element of sparse structs, whose zeros are not filled in.

    Entries become rows, combined before the shuffle; only elements that occur reach the driver.
    """
    c = F.col(name)
    n, size, least = df.agg(F.count(c), F.max(c["size"]), F.min(c["size"])).first()
    if not n:
        raise ValueError("the training set is empty")
    if size != least:
        raise ValueError(f"vectors of {least} and of {size} elements")
    entries = df.select(F.explode(F.arrays_zip(c["indices"].alias("i"), c["values"].alias("x"))).alias("e")).select("e.*").toDF("i", "x")
    out = [(0.0, 0.0, 0.0, 0.0)] * size
    for i, s, q, low, high, k in entries.groupBy("i").agg(F.sum("x"), F.sum(F.col("x") * F.col("x")), F.min("x"), F.max("x"), F.count("x")).collect():
        out[i] = (s, q, low if k == n else min(low, 0.0), high if k == n else max(high, 0.0))
    return n, out


def lit_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]) if values else F.array().cast("array<double>")
