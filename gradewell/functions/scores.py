"""Column expressions on scores."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.columns import col


def logistic(value: Column) -> Column:
    """1 / (1 + e^-d) of a decision value."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def positive_probability(probability: str = "probability") -> Column:
    """P(class 1) out of a Spark ML probability vector."""
    return vector_to_array(col(probability))[1]
