"""Run reports: metrics, parameters and messages as rows of one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.columns import col

_COLUMNS = "run_id string, kind string, name string, value string"


def run_report(spark: SparkSession, run_id: str, metrics: Mapping[str, float] | None = None,
               params: Mapping[str, object] | None = None,
               messages: Sequence[Mapping[str, object]] = ()) -> DataFrame:
    """(run_id, kind, name, value). A message has level, message, logger, function, line."""
    rows = [(run_id, "metric", k, repr(float(v))) for k, v in (metrics or {}).items()]
    rows += [(run_id, "param", k, str(v)) for k, v in (params or {}).items()]
    for m in messages:
        place = f"{m.get('logger', '')}:{m.get('function', '')}:{m.get('line', '')}"
        rows.append((run_id, f"log.{str(m['level']).lower()}", place, str(m["message"])))
    return spark.createDataFrame(rows, _COLUMNS)


def metric_rows(table: DataFrame, run_id: str, metrics: Sequence[str]) -> DataFrame:
    """A one-row table of metrics as report rows, without leaving Spark."""
    entries = [
        F.struct(F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"), F.lit(m).alias("name"),
                 col(m).cast("string").alias("value"))
        for m in metrics
    ]
    return table.select(F.inline(F.array(*entries)))


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)
