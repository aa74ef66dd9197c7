"""What must hold however large the input is: ties, late rows, large vocabularies, partitions side by side."""

import time

import pytest
from pyspark.sql import functions as F

from loomwork import operators as O
from loomwork.operators import classification, evaluation, indexers
from loomwork.plans import dataflow
from loomwork.streaming import online as S
from loomwork.streaming import windows as W


def test_precision_of_ties(spark, monkeypatch):
    """A run of equal records has the same area by the formula as record by record."""
    rows = [(0.9, 0.0)] * 3 + [(0.8, 1.0)] * 700 + [(0.8, 0.0)] * 40 + [(0.1, 1.0)] * 300 + [(0.05, 0.0)] * 9
    df = spark.createDataFrame(rows, "raw_prediction double, label double")
    area = lambda: O.BinaryClassificationEvaluator(metrics_names=["areaUnderPR"]).transform(df).first()[0]
    closed = area()
    monkeypatch.setattr(evaluation, "FEW", 1 << 20)
    assert abs(closed - area()) < 1e-12


def test_constant_score(spark):
    df = spark.range(30_000_000).select(F.lit(0.5).alias("raw_prediction"), (F.col("id") % 2).cast("double").alias("label"))
    assert 0.5 <= O.BinaryClassificationEvaluator().transform(df).first()[0] <= 1


def test_partitions_run_side_by_side(spark):
    df = spark.range(0, 8, 1, 8)

    def slow(acc, frame):
        time.sleep(1)
        return acc + int(frame["id"].sum())

    dataflow.aggregate(df, lambda: 0, lambda a, f: a + len(f), lambda a, b: a + b, lambda a: a)  # starts the workers
    began = time.perf_counter()
    assert dataflow.aggregate(df, lambda: 0, slow, lambda a, b: a + b, lambda a: a) == 28
    assert time.perf_counter() - began < 5  # four cores; one after the other they would take eight seconds
    assert dataflow.reduce_all(df, lambda f: f.agg(["sum"]).reset_index(drop=True)).first().id == 28
    assert dataflow.reduce_all(df.limit(0), lambda f: f).count() == 0


def test_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(indexers, "LITERAL", 2)
    df = spark.createDataFrame([(k % 5, k) for k in range(10)], "a int, k int")
    made = O.IndexToStringModel(input_cols=["a"], output_cols=["b"]).with_data(stringArrays=[list("vwxyz")])
    got = made.transform(df)
    assert got.columns == ["a", "k", "b"] and {(r.a, r.b) for r in got.collect()} == set(enumerate("vwxyz"))
    with pytest.raises(Exception, match="no such index"):
        made.transform(df.withColumn("a", F.lit(9))).collect()
    monkeypatch.setattr(indexers, "MOST", 4)
    with pytest.raises(ValueError, match="distinct values"):
        O.StringIndexer(input_cols=["a"], output_cols=["i"]).fit(df)
    monkeypatch.setattr(classification, "MOST_VALUES", 3)
    with pytest.raises(ValueError, match="categories"):
        O.NaiveBayes().fit(spark.createDataFrame([([float(k)], 0.0) for k in range(9)], "features array<double>, label double"))


def test_late_rows(spark, tmp_path):
    """A row of a closed window changes no version and is counted."""
    schema, source = "ts timestamp, input array<double>", str(tmp_path / "in")
    store = S.ModelStore(spark, str(tmp_path / "store"))
    assert store.batches() == [] and store.all() == []
    scaler = S.OnlineStandardScaler(windows=W.EventTimeTumblingWindows(10_000), time_col="ts")
    for part in ((1, 12), (2, 22, 25), (13, 31)):
        rows = spark.createDataFrame([(s, [float(s)]) for s in part], "s long, input array<double>")
        rows.select(F.timestamp_seconds("s").alias("ts"), "input").coalesce(1).write.mode("append").parquet(source)
        scaler.fit_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    got = scaler.stored(spark, store).versions.orderBy("version").collect()
    assert [r.timestamp for r in got] == [9999, 19999, 29999] and [r.mean[0] for r in got] == [1.0, 6.5, 15.0]
    assert store.before(99)["late"] == 2
