"""Binning state that grows month by month.

The state of some rows is one table of counts: the rows and events of every
feature in cells of equal leading bits (less than a millionth of a value wide),
of every category, and of missing values. States add up, so a new month is
counted alone and added to the stored ones, and bins follow from the sums
without reading any row: those of fit_binning(exact=False) over all rows.

Between a number and its double there are 2 ** 20 cells, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.columns import as_number, binary, classify_columns, col
from gradewell.operators.binning import Binning, category_counts, finished
from gradewell.operators.quantiles import _first_cells, from_bits, ordered_bits
from gradewell.workspace import staged

CELL_BITS = 32
_STATE = "feature string, kind string, cell bigint, category string, n bigint, events bigint"


def _numeric_state(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    names = list(features)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y, parts = batch["y"].to_numpy(dtype="int64"), []
            for f, name in enumerate(names):
                x = batch.iloc[:, f].to_numpy(dtype="float64")
                seen = ~np.isnan(x)
                cell, place = np.unique(ordered_bits(x[seen]) >> (64 - CELL_BITS), return_inverse=True)
                n, events = np.bincount(place, minlength=len(cell)), np.bincount(place, y[seen], len(cell)).astype("int64")
                parts.append(pd.DataFrame({"feature": name, "cell": pd.array(cell, dtype="Int64"), "n": n, "events": events}))
                if not seen.all():
                    parts.append(pd.DataFrame({"feature": [name], "cell": pd.array([None], dtype="Int64"), "n": [int((~seen).sum())], "events": [int(y[~seen].sum())]}))
            yield pd.concat(parts)

    narrow = df.where(col(label).isNotNull()).select(
        *[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)], binary(df, label).alias("y")
    )
    counted = narrow.mapInPandas(count, "feature string, cell long, n long, events long")
    return counted.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))


@dataclass(frozen=True)
class BinState:
    """Counts of some rows; `table` may hold several rows per cell or category, which add up."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    table: DataFrame

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], label: str) -> BinState:
        """The state of the rows of df that have a label: one scan for numbers and one for categories."""
        numeric, categorical = classify_columns(df, features)
        table = df.sparkSession.createDataFrame([], _STATE)
        if numeric:
            table = table.unionByName(_numeric_state(df, numeric, label).withColumn("kind", F.lit("numeric")), allowMissingColumns=True)
        if categorical:
            counted = category_counts(df, label, categorical).drop("fold").withColumn("kind", F.lit("categorical"))
            table = table.unionByName(counted, allowMissingColumns=True)
        return BinState(tuple(numeric), tuple(categorical), table)

    def merge(self, other: BinState) -> BinState:
        """The state of both sets of rows."""
        if (self.numeric, self.categorical) != (other.numeric, other.categorical):
            raise ValueError("the states count different features")
        both = self.table.unionByName(other.table)
        return BinState(self.numeric, self.categorical, _added(both))

    def add(self, df: DataFrame, label: str) -> BinState:
        """The state with the rows of df, which alone are read."""
        return self.merge(BinState.of(df, [*self.numeric, *self.categorical], label))

    def save(self, path: str, append: bool = False) -> None:
        """Write the counts; append=True adds them to the states already there."""
        self.table.coalesce(1).write.mode("append" if append else "overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BinState:
        table = _added(spark.read.schema(_STATE).parquet(path))
        names = table.select("kind", "feature").distinct().collect()
        numeric, categorical = (tuple(sorted(r["feature"] for r in names if r["kind"] == k)) for k in ("numeric", "categorical"))
        return BinState(numeric, categorical, table)

    def binning(self, **option) -> Binning:
        """Bins by the settings of fit_binning, of which exact is always False."""
        state, spark = staged(self.table, "bin-state"), self.table.sparkSession
        bins, numeric = int(option.get("bins", 20)), list(self.numeric)
        edges, spans = {}, []
        if numeric:
            mine = state.where("kind = 'numeric'")
            number = F.array_position(F.array(*[F.lit(c) for c in numeric]), col("feature")).cast("int") - 1
            cells = mine.where("cell is not null").select(F.lit(0).alias("t"), number.alias("f"), "cell", "n")
            held: dict[int, set[int]] = {}
            for _, f, cell, _, _, _ in _first_cells(cells, [bins]):
                held.setdefault(f, set()).add(cell)
            # The last cell holds the maximum: no edge.
            cuts = {c: sorted(held.get(f, ()))[:-1] for f, c in enumerate(numeric)}
            ends = (np.int64(1) << (64 - CELL_BITS)) - 1
            edges = {c: [float(v) for v in from_bits((np.array(cut, np.int64) << (64 - CELL_BITS)) | ends)] for c, cut in cuts.items()}
            table = spark.createDataFrame([(c, cut) for c, cut in cuts.items()], "feature string, cuts array<bigint>")
            place = F.when(col("cell").isNotNull(), F.size(F.filter("cuts", lambda e: e < col("cell"))))
            counted = mine.join(F.broadcast(table), "feature").groupBy("feature", place.alias("bin"))
            spans = [tuple(r) for r in counted.agg(F.sum("n"), F.sum("events")).collect()]
        categories = None
        if self.categorical:
            categories = state.where("kind = 'categorical'").select("feature", "category", "n", "events")
        first = [*numeric, *self.categorical][0]
        rows, events = state.where(col("feature") == F.lit(first)).agg(F.sum("n"), F.sum("events")).first()
        totals = int(events or 0), int(rows or 0) - int(events or 0)
        return finished(spark, spans, edges, categories, self.categorical, totals, option)


def _added(table: DataFrame) -> DataFrame:
    return table.groupBy("feature", "kind", "cell", "category").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
