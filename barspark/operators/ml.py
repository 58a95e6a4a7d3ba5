"""Factor models with Spark ML: forward returns on factors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def training_rows(panel: DataFrame, factors: list[str], close: str = "close", ahead: int = 1) -> DataFrame:
    """symbol, ts, the factors, y: the return over the next `ahead` bars; complete rows only."""
    later = F.lead(close, ahead).over(W.partitionBy("symbol").orderBy("ts"))
    return panel.withColumn("y", F.try_divide(later, F.col(close)) - 1).select("symbol", "ts", *factors, "y").na.drop()


def fit(rows: DataFrame, factors: list[str], kind: str = "linear", alpha: float = 1.0, trees: int = 100, seed: int = 0):
    """A fitted pipeline stage pair as one function: rows -> rows with `prediction`; and the model. alpha is the weight of the squared coefficients beside the sum of squared errors."""
    assemble = VectorAssembler(inputCols=factors, outputCol="_x")
    ready = assemble.transform(rows)
    if kind == "linear":
        model = LinearRegression(featuresCol="_x", labelCol="y", solver="normal").fit(ready)
    elif kind == "ridge":
        model = LinearRegression(featuresCol="_x", labelCol="y", solver="normal", regParam=alpha / max(ready.count(), 1), elasticNetParam=0.0, standardization=False).fit(ready)
    elif kind == "random_forest":
        model = RandomForestRegressor(featuresCol="_x", labelCol="y", numTrees=trees, seed=seed).fit(ready)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return lambda df: model.transform(assemble.transform(df)).drop("_x"), model


def scores(predict, panel: DataFrame, factors: list[str]) -> DataFrame:
    """ts, symbol, score: what the model expects of each symbol."""
    return predict(panel.na.drop(subset=factors)).select("ts", "symbol", F.col("prediction").alias("score"))
