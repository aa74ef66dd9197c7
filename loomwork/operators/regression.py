"""Linear regression."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..core import vectors as V
from ..core.params import HasFeaturesCol, HasPredictionCol
from ..core.stage import Estimator, Model
from .linear import SGDParams, descend, dot_with, square_loss


class LinearRegressionModel(Model, HasFeaturesCol, HasPredictionCol):
    MODEL_SCHEMA = "coefficient array<double>"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction_col, dot_with(V.dense(df, self.features_col), self.need()["coefficient"]))


class LinearRegression(Estimator, SGDParams, HasPredictionCol):
    """Least squares by mini-batch descent, without an intercept."""

    def fit(self, df: DataFrame) -> LinearRegressionModel:
        return self.model(LinearRegressionModel(), coefficient=descend(self, df, square_loss, False))
