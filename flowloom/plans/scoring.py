"""A baseline scorer, so that the score operators have something to work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame

from flowloom.operators.encode import class_weights
from flowloom.scale import c, small_side
from flowloom.session import durable


def fit_scorer(train: DataFrame, features: Sequence[str], num_classes: int, max_iter: int = 20) -> PipelineModel:
    """Class-weighted logistic regression on numeric columns."""
    weights = class_weights(train, num_classes).select("label_id", "weight")
    weighted = train.join(small_side(weights), "label_id")
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_scaled"),
        LogisticRegression(
            featuresCol="_scaled", labelCol="label_id", weightCol="weight", family="multinomial", maxIter=max_iter
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add `logits` as an array column."""
    scored = model.transform(df)
    added = [n for n in scored.columns if n not in df.columns]
    return scored.withColumn("logits", vector_to_array("rawPrediction")).drop(*added)


def train_scores(df: DataFrame, is_train: Column, features: Sequence[str], num_classes: int) -> DataFrame:
    """Fit on the rows where `is_train` holds, score all rows. The numeric table is checkpointed for the iterations."""
    names = [n.replace(".", "_") for n in features]
    doubles = [c(n).cast("double").alias(name) for n, name in zip(features, names, strict=True)]
    keep = [n for n in ("packet_id", "frame_num", "stream_id", "label_id") if n in df.columns]
    numeric = durable(df.select(*keep, is_train.alias("_train"), *doubles))
    model = fit_scorer(numeric.filter("_train"), names, num_classes)
    return score(model, numeric).select(*keep, "logits")
