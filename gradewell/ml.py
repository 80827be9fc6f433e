"""Spark ML stages over the DataFrame operators, for Pipeline and model search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame

from gradewell.columns import col
from gradewell.operators.binning import Binning, fit_binnings, woe_transform
from gradewell.operators.metrics import ginis
from gradewell.operators.select import mrmr_select


class _WoeParams(HasInputCols, HasLabelCol):
    missing = Param(Params._dummy(), "missing", "'zero' or 'woe'", typeConverter=TypeConverters.toString)

    def woe_columns(self) -> list[str]:
        return [f"{c}_WOE" for c in self.getInputCols()]


class WoeEstimator(Estimator, _WoeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits bins for the input columns; the model adds <name>_WOE columns."""

    bins = Param(Params._dummy(), "bins", "quantile pre-bins", typeConverter=TypeConverters.toInt)
    trend = Param(Params._dummy(), "trend", "event rate trend, 'none' to keep pre-bins", typeConverter=TypeConverters.toString)
    minShare = Param(Params._dummy(), "minShare", "least share of rows per merged bin", typeConverter=TypeConverters.toFloat)
    exact = Param(Params._dummy(), "exact", "exact quantiles", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols=None, labelCol="label", bins=20, trend="auto", minShare=0.0, exact=True, missing="zero"):
        super().__init__()
        self._setDefault(labelCol="label", bins=20, trend="auto", minShare=0.0, exact=True, missing="zero")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> WoeModel:
        return fit_together(dataset, [self])[0][0]

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, WoeModel]]:
        """All settings from the same scans, where they bin the same columns."""
        variants = [self.copy(point) for point in paramMaps]
        same = {(tuple(v.getInputCols()), v.getLabelCol(), v.getOrDefault(v.exact)) for v in variants}
        if len(same) != 1:
            return super().fitMultiple(dataset, paramMaps)
        return iter(enumerate(fit_together(dataset, variants)[0]))

    def fit_folds(self, dataset: DataFrame, fold_col: str, folds: int) -> list[WoeModel]:
        """For every fold the model of all other rows, all from the same scans."""
        return [models[0] for models in fit_together(dataset, [self], fold_col, folds)]


def fit_together(dataset: DataFrame, variants: Sequence[WoeEstimator], fold_col: str | None = None, folds: int = 0) -> list[list[WoeModel]]:
    """The models of several settings over the same columns, from the same scans: [training set][variant].
    With folds, training set i has all rows but those of fold i."""
    first = variants[0]
    options = []
    for v in variants:
        trend = v.getOrDefault(v.trend)
        options.append({"bins": v.getOrDefault(v.bins), "trend": None if trend == "none" else trend, "min_share": v.getOrDefault(v.minShare)})
    found = fit_binnings(
        dataset, first.getInputCols(), first.getLabelCol(), options, fold_col, folds, exact=first.getOrDefault(first.exact)
    )
    return [[_woe_model(v, binning) for v, binning in zip(variants, row)] for row in found]


def _woe_model(estimator: WoeEstimator, binning: Binning) -> WoeModel:
    model = WoeModel(inputCols=estimator.getInputCols(), missing=estimator.getOrDefault(estimator.missing))
    model.binning = binning
    return model


class WoeModel(Model, _WoeParams, MLWritable, MLReadable):
    """Adds <name>_WOE; saved as its params and a parquet bin table."""

    binning: Binning

    @keyword_only
    def __init__(self, inputCols=None, missing="zero"):
        super().__init__()
        self._setDefault(missing="zero")
        self._set(**self._input_kwargs)

    def output_columns(self) -> list[str]:
        return self.woe_columns()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return woe_transform(dataset, self.binning, self.getInputCols(), missing=self.getOrDefault(self.missing))

    def copy(self, extra=None) -> WoeModel:
        twin = super().copy(extra)
        twin.binning = self.binning
        return twin

    def write(self) -> MLWriter:
        return _WoeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _WoeReader(cls)


class _WoeWriter(MLWriter):
    def __init__(self, model: WoeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.binning.save(f"{path}/bins")


class _WoeReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> WoeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, expectedClassName=f"{self.cls.__module__}.{self.cls.__name__}")
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.binning = Binning.load(self.sparkSession, f"{path}/bins")
        return model


class MrmrSelector(Estimator, HasInputCols, HasOutputCol, HasLabelCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Selects numFeatures input columns; the model assembles them."""

    @keyword_only
    def __init__(self, inputCols=None, numFeatures=10, labelCol="label", outputCol="features"):
        super().__init__()
        self._setDefault(numFeatures=10, labelCol="label", outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorAssembler:
        chosen = mrmr_select(dataset, self.getInputCols(), self.getLabelCol(), self.getNumFeatures()).orderBy("rank").collect()
        return VectorAssembler(inputCols=[r["feature"] for r in chosen], outputCol=self.getOutputCol())


class GiniEvaluator(Evaluator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Exact Gini of the score column: by default the probability of class 1.
    scoreCol='prediction' gives the Gini of the hard classes."""

    scoreCol = Param(Params._dummy(), "scoreCol", "probability vector or number", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, scoreCol="probability", labelCol="label"):
        super().__init__()
        self._setDefault(scoreCol="probability", labelCol="label")
        self._set(**self._input_kwargs)

    def columns_read(self) -> list[str]:
        return [self.getLabelCol(), self.getOrDefault(self.scoreCol)]

    def _score(self, dataset: DataFrame) -> Column:
        name = self.getOrDefault(self.scoreCol)
        return vector_to_array(col(name))[1] if isinstance(dataset.schema[name].dataType, VectorUDT) else col(name)

    def _evaluate(self, dataset: DataFrame) -> float:
        return self.compare(dataset.select(col(self.getLabelCol()).alias("label"), self._score(dataset).alias("score_0")), 1)[0]

    def compare(self, scores: DataFrame, count: int) -> list[float]:
        """The Gini of score_0, score_1, ... against the column label."""
        found = ginis(scores, [f"score_{i}" for i in range(count)], "label")
        return [float("nan") if found.get(f"score_{i}") is None else found[f"score_{i}"] for i in range(count)]

    def evaluate_models(self, models: Sequence[Model], dataset: DataFrame) -> list[float]:
        """The score of every model on the same rows, all from the same passes."""
        base, rows = dataset.columns, dataset
        for i, model in enumerate(models):
            scored = model.transform(rows)
            rows = scored.select(*[col(c) for c in base], *[col(f"score_{j}") for j in range(i)], self._score(scored).alias(f"score_{i}"))
        names = [col(f"score_{i}") for i in range(len(models))]
        return self.compare(rows.select(col(self.getLabelCol()).alias("label"), *names), len(models))

    def isLargerBetter(self) -> bool:
        return True
