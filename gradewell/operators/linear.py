"""Logistic regression on assembled features, and plain linear scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.functions.scores import logistic, positive_probability
from gradewell.operators.calibrate import IsotonicModel


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """One vector column of the features; a null raises."""
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * rows of the own class), as a weight column."""
    row = df.agg(F.count_if(col(label) == 1).alias("p"), F.count_if(col(label) == 0).alias("q")).first()
    total = float(row.p + row.q)
    weight = F.when(col(label) == 1, F.lit(total / (2.0 * max(row.p, 1)))).otherwise(F.lit(total / (2.0 * max(row.q, 1))))
    return df.withColumn(out, weight)


def logistic_fit(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0, elastic: float = 0.0,
                 weight: str | None = None, tol: float = 1e-6, max_iter: int = 100) -> PipelineModel:
    """Assembler and logistic regression, fitted."""
    regression = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=elastic, tol=tol, maxIter=max_iter
    )
    if weight:
        regression = regression.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), regression]).fit(df)


def logistic_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """The table with P(event) and the class at 0.5; model vectors are dropped.
    Columns of these two names in the table are replaced."""
    scored, kept = transformed(model, df, (out, "prediction"))
    return scored.select(*kept, positive_probability().alias(out), col("prediction").alias("prediction"))


def _stages(model) -> list:
    return [s for part in model.stages for s in _stages(part)] if isinstance(model, PipelineModel) else [model]


def _columns_of(stage, names: Sequence[str]) -> list[str]:
    """The columns that the named parameters of a stage hold."""
    found: list[str] = []
    for name in names:
        if stage.hasParam(name) and stage.isDefined(name):
            value = stage.getOrDefault(name)
            found += [value] if isinstance(value, str) else list(value)
    return [c for c in found if c]


def stage_outputs(stage) -> list[str]:
    """The columns a fitted stage adds."""
    own = list(stage.output_columns()) if hasattr(stage, "output_columns") else []
    return own + _columns_of(stage, ("outputCol", "outputCols", "predictionCol", "probabilityCol", "rawPredictionCol"))


def transformed(model, df: DataFrame, replaced: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """(model output, df's own columns in it but those `replaced`).

    Columns of df that bear the name of a model output, as the scores of an
    earlier model do, are set aside under a private name first. One that the
    model also reads is refused.
    """
    read: set[str] = set()
    written: set[str] = set()
    for stage in _stages(model):
        read.update(c for c in _columns_of(stage, ("inputCol", "inputCols", "featuresCol")) if c not in written)
        written.update(stage_outputs(stage))
    both = sorted(read & written & set(df.columns))
    if both:
        raise ValueError(f"the model reads and writes the same columns: {both}")
    aside = {c: f"__own_{i}" for i, c in enumerate(df.columns) if c in written or (c in replaced and c not in read)}
    own = df.select(*[col(c).alias(aside.get(c, c)) for c in df.columns])
    kept = [col(aside.get(c, c)).alias(c) for c in df.columns if c not in replaced]
    return model.transform(own), kept


def event_score(model) -> Column:
    """The event probability in the output of a fitted model, told from its
    stages: calibrated, a score of its own, or the probability of class 1."""
    for stage in reversed(_stages(model)):
        if isinstance(stage, IsotonicModel):
            return col(stage.getPredictionCol())
        if isinstance(stage, LinearScore):
            return col("score")
        if stage.hasParam("probabilityCol"):
            return positive_probability(stage.getOrDefault("probabilityCol"))
    raise ValueError("no stage of the model gives a score")


class LinearScore(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """decision = weights . features + bias, score = 1 / (1 + e^-decision), prediction = score >= 0.5."""

    weights = Param(Params._dummy(), "weights", "one weight per input column", typeConverter=TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, weights=None, bias=None):
        super().__init__()
        self._setDefault(weights=[], bias=0.0)
        self._set(**self._input_kwargs)

    def output_columns(self) -> tuple[str, str]:
        return "score", "prediction"

    def decision(self) -> Column:
        total = F.lit(self.getOrDefault(self.bias))
        for name, weight in zip(self.getInputCols(), self.getOrDefault(self.weights)):
            total = total + col(name).cast("double") * F.lit(weight)
        return total

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = logistic(self.decision())
        return dataset.withColumn("score", score).withColumn("prediction", (col("score") >= 0.5).cast("double"))
