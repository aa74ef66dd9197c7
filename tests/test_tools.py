import pandas as pd
import pytest

from loomwork import benchmark
from loomwork import operators as O
from loomwork.core.pipeline import Pipeline
from loomwork.servable import LogisticRegressionModelServable, PipelineModelServable


def test_servable(spark, tmp_path):
    rows = [([float(x), 2.0], 0.0 if x < 5 else 1.0) for x in (1, 2, 3, 11, 12, 13)]
    df = spark.createDataFrame(rows, "features array<double>, label double")
    made = Pipeline([O.LogisticRegression(max_iter=50)]).fit(df)
    made.save(spark, str(tmp_path / "p"))
    want = [(r.prediction, r.raw_prediction[1]) for r in made.transform(df).collect()]
    out = PipelineModelServable.load(str(tmp_path / "p")).transform(pd.DataFrame(rows, columns=["features", "label"]))
    assert [p for p, _ in want] == out["prediction"].tolist()
    assert max(abs(a[1] - b) for a, (_, b) in zip(out["raw_prediction"], want, strict=True)) < 1e-12
    one = LogisticRegressionModelServable().set_model_data([1.0, -1.0, 2.0])
    assert one.transform(pd.DataFrame({"features": [(3, [0, 1], [1.0, 3.0])]}))["prediction"].tolist() == [0.0]
    Pipeline([O.Tokenizer()]).fit(df).save(spark, str(tmp_path / "q"))
    with pytest.raises(ValueError, match="served"):
        PipelineModelServable.load(str(tmp_path / "q"))


def test_benchmark(spark):
    made = {"className": "org.x.DenseVectorGenerator", "paramMap": {"seed": 2, "vectorDim": 3, "numValues": 100, "colNames": [["features"]]}}
    got = benchmark.run(spark, {
        "version": 1,
        "fit": {"stage": {"className": "KMeans", "paramMap": {"maxIter": 2}}, "inputData": made},
        "model": {"stage": {"className": "KMeansModel", "paramMap": {"k": 2}}, "inputData": made, "modelData": {"className": "KMeansModelDataGenerator", "paramMap": {"vectorDim": 3, "arraySize": 2}}},
        "bad": {"stage": {"className": "KMeans", "paramMap": {"noSuch": 1}}, "inputData": made},
    })
    assert got["fit"]["results"]["inputRecordNum"] == 100 and got["model"]["results"]["outputRecordNum"] == 100
    assert "no parameter" in got["bad"]["exception"] and "version" not in got
