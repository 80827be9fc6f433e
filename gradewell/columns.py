"""Column roles and the one typing rule used by every operator.

NumericType columns are numeric, string and boolean columns are categorical,
anything else (dates, arrays, maps, structs, binary) is refused by name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """What each column of the modelling table is for."""

    target: str
    strata: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)

    def features(self, df: DataFrame) -> list[str]:
        return feature_names(df, self.exclude, self.target)


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def feature_names(df: DataFrame, exclude: Iterable[str], target: str | None = None) -> list[str]:
    """All columns but the excluded ones and the target, in table order.

    Unknown excluded names raise; the message also lists the names found.
    """
    drop = list(dict.fromkeys([*exclude, *([target] if target else [])]))
    missing = [c for c in drop if c not in df.columns]
    if missing:
        found = [c for c in drop if c in df.columns]
        raise ValueError(f"columns to exclude are not in the table: {missing}; present: {found}")
    return [c for c in df.columns if c not in set(drop)]


def feature_columns(df: DataFrame, exclude: Iterable[str], target: str | None = None) -> DataFrame:
    """The feature projection itself."""
    return df.select(*[col(c) for c in feature_names(df, exclude, target)])


def classify_columns(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split features into (numeric, categorical) by their Spark type."""
    numeric: list[str] = []
    categorical: list[str] = []
    for name in features:
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            numeric.append(name)
        elif isinstance(kind, (T.StringType, T.BooleanType)):
            categorical.append(name)
        else:
            raise TypeError(f"column {name!r} has type {kind.simpleString()}: neither numeric nor categorical")
    return numeric, categorical


def as_number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, with NaN read as missing."""
    value = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    return value


def binary(df: DataFrame, name: str) -> Column:
    """A 0/1 column (number or boolean) as a long, null kept. Any other value stops
    the job with an error that names the column, in whatever pass reads it."""
    value = col(name).cast("double")
    found = F.concat(F.lit(f"column {name!r} must hold 0, 1 or null; found "), value.cast("string"))
    return F.when(value.isNull(), F.lit(None)).when(value.isin(0.0, 1.0), value.cast("bigint")).otherwise(F.raise_error(found).cast("bigint"))


def nullable_schema(df: DataFrame) -> T.StructType:
    """The same schema with every field nullable, for reading a folder of batches."""
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull())


def select_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Only the columns a fit reads."""
    return df.select(*[col(c) for c in features], col(label))


def positive_label(df: DataFrame, target: str, positive=1, out: str = "label") -> DataFrame:
    """1.0 where the target is the named positive value, 0.0 otherwise, null kept."""
    return df.withColumn(out, (col(target) == F.lit(positive)).cast("double"))
