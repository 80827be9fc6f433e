"""Isotonic calibration: a rising step from score to event probability.

Rows are added up to distinct scores, which are dealt out in ranges of the score.
Each task pools adjacent violators in its range to blocks; then the blocks of two
neighbouring ranges are pooled together, round by round. A block whose rate no
earlier range exceeds and no later one falls short of stays as it is and takes no
part any more, so what is still moved are the blocks around violations. Blocks stay a
table; only the ends of ranges come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.param.shared import HasInputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import as_number, binary, col
from gradewell.operators.quantiles import ordered_bits
from gradewell.workspace import BROADCAST_ROWS, attach, staged

_BLOCKS = "part long, low double, high double, n long, events long"
# Leading bits of a score that make the cell in which its block is looked up, where there are many blocks.
CELL_BITS = 20


def score_sums(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, n, events) per distinct score."""
    return (
        df.select((as_number(df, score) + 0.0).alias("score"), binary(df, label).alias("y"))
        .where(col("score").isNotNull() & col("y").isNotNull())
        .groupBy("score")
        .agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("events"))
    )


class _Stack:
    """Blocks (low, high, n, events) in rising order of their rates; a new one is pooled with those it falls short of."""

    def __init__(self):
        self.rows: list[tuple[float, float, int, int]] = []

    def add(self, low: float, high: float, n: int, events: int) -> None:
        rows = self.rows
        # rates compared in whole numbers
        while rows and rows[-1][3] * n >= events * rows[-1][2]:
            first, _, more, others = rows.pop()
            low, n, events = first, n + more, events + others
        rows.append((low, high, n, events))


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (part, low, high, n, events) in order of part and low: the blocks of every part."""
    now, stack = None, _Stack()

    def out() -> pd.DataFrame:
        return pd.DataFrame([(now, *r) for r in stack.rows], columns=["part", "low", "high", "n", "events"])

    for batch in batches:
        for part, *row in zip(*(batch[c].tolist() for c in ("part", "low", "high", "n", "events"))):
            if part != now:
                if stack.rows:
                    yield out()
                now, stack = part, _Stack()
            stack.add(*row)
    if stack.rows:
        yield out()


def _pooled_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    yield from _pooled(b.assign(part=part, low=b["score"], high=b["score"]) for b in batches)


def pooled_blocks(sums: DataFrame, ranges: int | None = None) -> DataFrame:
    """(low, high, n, events): the blocks of the isotonic fit of (score, n, events)."""
    dealt = sums.repartitionByRange(ranges, "score") if ranges else sums.repartitionByRange("score")
    blocks = staged(dealt.sortWithinPartitions("score").mapInPandas(_pooled_range, _BLOCKS), "blocks")
    rate, done = col("events") / col("n"), []
    while True:
        # One row per range: where its rates begin and end.
        ends = blocks.groupBy("part").agg(F.min(rate).alias("least"), F.max(rate).alias("most")).orderBy("part").collect()
        if len(ends) <= 1:
            break
        least, most = np.array([r["least"] for r in ends]), np.array([r["most"] for r in ends])
        before = np.r_[-np.inf, np.maximum.accumulate(most)[:-1]]
        after = np.r_[np.minimum.accumulate(least[::-1])[::-1][1:], np.inf]
        limits = blocks.sparkSession.createDataFrame(
            [(r["part"], float(a), float(b)) for r, a, b in zip(ends, before, after)], "part long, before double, after double"
        )
        placed = blocks.join(F.broadcast(limits), "part")
        closed = (rate >= col("before")) & (rate <= col("after"))
        done.append(placed.where(closed).drop("part", "before", "after"))
        # Ranges are numbered anew, so each round halves them also where some have nothing left.
        number = F.array_position(F.array(*[F.lit(r["part"]) for r in ends]), col("part")) - 1
        left = placed.where(~closed).withColumn("part", F.floor(number / 2).cast("bigint"))
        left = left.drop("before", "after").repartition("part").sortWithinPartitions("part", "low")
        blocks = staged(left.mapInPandas(_pooled, _BLOCKS), "blocks")
    return reduce(DataFrame.unionByName, [*done, blocks.drop("part")])


class IsotonicModel(Model, HasInputCol, HasPredictionCol, MLWritable, MLReadable):
    """Rises from block to block: constant inside one, linear between two, the first and last value beyond the ends."""

    blocks: DataFrame

    @keyword_only
    def __init__(self, inputCol="score", predictionCol="calibrated"):
        super().__init__()
        self._setDefault(inputCol="score", predictionCol="calibrated")
        self._set(**self._input_kwargs)

    @property
    def boundaries(self) -> np.ndarray:
        """The ends of the blocks, to look at: they come to the driver."""
        rows = self.blocks.select("low", "high").orderBy("low").collect()
        return np.unique(np.array([tuple(r) for r in rows]))

    def copy(self, extra=None) -> IsotonicModel:
        twin = super().copy(extra)
        twin.blocks = self.blocks
        return twin

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x, out = as_number(dataset, self.getInputCol()) + 0.0, self.getPredictionCol()
        table = self.blocks.select("low", "high", (col("events") / col("n")).alias("value"))
        few = table.limit(BROADCAST_ROWS + 1).collect()
        if len(few) <= BROADCAST_ROWS:
            return dataset.withColumn(out, _steps(few)(x) if few else F.lit(None).cast("double"))
        return _by_cells(dataset, table, x, out)

    def write(self) -> MLWriter:
        return _IsotonicWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IsotonicReader(cls)


class _IsotonicWriter(MLWriter):
    def __init__(self, model: IsotonicModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.blocks.write.mode("overwrite").parquet(f"{path}/blocks")


class _IsotonicReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> IsotonicModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, expectedClassName=f"{self.cls.__module__}.{self.cls.__name__}")
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.blocks = self.sparkSession.read.parquet(f"{path}/blocks")
        return model


def _steps(rows: list):
    """The value at a score, from a bounded number of blocks."""
    rows = sorted(rows)
    ends = np.array([(r["low"], r["high"]) for r in rows]).ravel()
    values = np.repeat([r["value"] for r in rows], 2)

    @F.pandas_udf("double")
    def at(x: pd.Series) -> pd.Series:
        score = x.to_numpy(dtype="float64")
        return pd.Series(np.where(np.isnan(score), None, np.interp(score, ends, values)), dtype="float64")

    return at


def _cell(x: Column) -> Column:
    @F.pandas_udf("bigint")
    def leading(v: pd.Series) -> pd.Series:
        return pd.Series(ordered_bits(v.to_numpy(dtype="float64")) >> (64 - CELL_BITS))

    return leading(x)


def _by_cells(dataset: DataFrame, table: DataFrame, x: Column, out: str) -> DataFrame:
    """The value at every score, from blocks that meet the rows by cells of leading bits. A cell's list
    begins with the last block before it and ends with the first one behind."""
    lists = table.withColumn("cell", _cell(col("low"))).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("low", "high", "value"))).alias("own"))
    rows = dataset.withColumn("__x", x).withColumn("__cell", F.when(col("__x").isNotNull(), _cell(F.coalesce("__x", F.lit(0.0)))))
    # At most 2 ** CELL_BITS cells: those that rows or blocks are in, in one order.
    cells = rows.where("__cell is not null").select(col("__cell").alias("cell")).distinct().join(lists, "cell", "full_outer")
    order = Window.partitionBy(F.lit(1)).orderBy("cell")
    earlier = F.last(F.element_at("own", -1), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(F.element_at("own", 1), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    none = F.expr("cast(array() as array<struct<low:double,high:double,value:double>>)")
    near = F.concat(
        F.when(earlier.isNotNull(), F.array(earlier)).otherwise(none), F.coalesce("own", none),
        F.when(later.isNotNull(), F.array(later)).otherwise(none),
    )
    found = staged(cells.select(col("cell").alias("__cell"), near.alias("__near")), "cells")
    joined = attach(rows, found, ["__cell"])
    lower = F.try_element_at(F.filter("__near", lambda b: b["low"] <= col("__x")), F.lit(-1))
    upper = F.try_element_at(F.filter("__near", lambda b: b["low"] > col("__x")), F.lit(1))
    share = (col("__x") - lower["high"]) / (upper["low"] - lower["high"])
    value = (
        F.when(col("__x").isNull(), F.lit(None).cast("double")).when(lower.isNull(), upper["value"])
        .when((col("__x") <= lower["high"]) | upper.isNull(), lower["value"])
        .otherwise(lower["value"] + share * (upper["value"] - lower["value"]))
    )
    return joined.withColumn(out, value).drop("__x", "__cell", "__near")


def isotonic_fit(df: DataFrame, score: str, label: str, out: str = "calibrated") -> IsotonicModel:
    """Fit on distinct scores weighted by their rows, then apply to column `score`."""
    model = IsotonicModel(inputCol=score, predictionCol=out)
    model.blocks = staged(pooled_blocks(score_sums(df, score, label)), "isotonic")
    return model


def isotonic_calibrate(df: DataFrame, score: str, label: str, out: str = "calibrated") -> DataFrame:
    """The table with the calibrated probability of its own score."""
    return isotonic_fit(df, score, label, out).transform(df)
