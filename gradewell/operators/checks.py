"""Data checks: shapes, class counts, keys, nulls, column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col


def class_distribution(df: DataFrame, target: str, strata: Sequence[str] = ()) -> DataFrame:
    """Rows per class (and stratum)."""
    return df.groupBy(*[col(c) for c in strata], col(target)).agg(F.count("*").alias("n"))


def row_shape(df: DataFrame, split: str | None = None) -> DataFrame:
    """Rows and columns, per part when a split column is named, in one job."""
    width = len([c for c in df.columns if c != split])
    keys = [col(split)] if split else []
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(width))


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")


def _unpivot(row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """One wide row of per-column results as rows (name, value)."""
    entries = [F.struct(F.lit(c).alias("name"), col(f"c{i}").alias(value)) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*entries)))


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """name, data_type, nullable, max_len: the longest text per string column,
    from a scan of the string columns only."""
    columns = list(columns) if columns else df.columns
    _require(df, columns)
    entries = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        longest = F.max(F.length(col(c))) if kind == "string" else F.lit(None)
        entries.append(F.struct(
            F.lit(c).alias("name"), F.lit(kind).alias("data_type"),
            F.lit(df.schema[c].nullable).alias("nullable"), longest.cast("int").alias("max_len"),
        ))
    return df.agg(F.array(*entries).alias("__types")).select(F.inline("__types"))


def not_null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that hold nulls, and how many; empty when all are filled."""
    _require(df, columns)
    row = df.agg(*[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    return _unpivot(row, columns, "nulls").where("nulls > 0")


def unique_key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break a primary key: held by several rows or partly null."""
    _require(df, keys)
    has_null = F.lit(False)
    for c in keys:
        has_null = has_null | col(c).isNull()
    return (
        df.groupBy(*[col(c) for c in keys]).agg(F.count("*").alias("n"))
        .where((col("n") > 1) | has_null)
    )


def constant_filter(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features with at most one distinct value; nulls count as a value."""
    row = df.agg(*[
        (((F.min(col(c)) == F.max(col(c))) & (F.count(col(c)) == F.count("*"))) | (F.count(col(c)) == 0)).alias(f"c{i}")
        for i, c in enumerate(features)
    ])
    return _unpivot(row, features, "constant").where("constant").select(col("name").alias("feature"))
