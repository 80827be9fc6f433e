"""The data jobs around a model: split a table, score a table, evaluate scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from gradewell.columns import Roles, drop_null_target
from gradewell.operators.checks import class_distribution, row_shape
from gradewell.operators.linear import event_score, transformed
from gradewell.operators.metrics import calibration_curve, confusion_metrics, rank_metrics
from gradewell.operators.split import split_exact, split_hash
from gradewell.sources.parquet import parquet_scan, parquet_sink


def split_job(source: DataFrame, roles: Roles, path: str, train_size: float, seed: object, key: Sequence[str],
              exact: bool = False, preprocess: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Drop rows without a target, split by strata, write once, and return rows
    and columns per part as counted on the written files."""
    table = preprocess(drop_null_target(source, roles.target))
    strata = list(roles.strata)
    parts = split_exact(table, strata, train_size, seed, key) if exact else split_hash(table, key, train_size, seed)
    parquet_sink(parts, path, partition_by="split")
    return row_shape(parquet_scan(source.sparkSession, path), "split")


def score_frame(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns with `score`, the event probability (calibrated if the
    model calibrates), and `prediction`, the class at 0.5. Columns of these names
    in the input, left by an earlier model, are replaced."""
    scored, kept = transformed(model, df, ("score", "prediction"))
    score = event_score(model)
    return scored.select(*kept, score.alias("score"), (score >= 0.5).cast("double").alias("prediction"))


def evaluate_scores(scored: DataFrame, target: str, score: str = "score", prediction: str = "prediction") -> dict[str, DataFrame]:
    """The evaluation tables of a scored hold-out part."""
    return {
        "rank": rank_metrics(scored, score, target),
        "calibration": calibration_curve(scored, score, target),
        "classes": confusion_metrics(scored, prediction, target),
        "distribution": class_distribution(scored, target),
    }
