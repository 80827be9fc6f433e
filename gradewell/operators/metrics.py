"""Evaluation of scores and classes against a 0/1 label.

Rank metrics (AUC, Gini, KS) are exact and tie-aware. Doubles map to 64-bit
integers in the same order, and tasks count the classes in cells of equal leading
bits. A cell that holds one class or one value is done: how its rows are ordered
changes neither metric. Only mixed cells are looked into: large ones are counted
again by more bits, small ones are ranked in a task from their distinct values,
which are added up before they are shuffled. All features are counted in the same
scans, and cells are put together from their totals.
Rows without a label or score are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import as_number, binary, col
from gradewell.operators.quantiles import ordered_bits

# Leading bits known after each count.
STEPS = (20, 32, 44, 64)
# A mixed cell of up to this many rows is ranked in one task.
RANKED_ROWS = 1 << 16
# Cells or values, of all features together, that a task holds before it hands them on.
HELD = 1 << 18

_RANKED = "name string, n bigint, events bigint, auc double, gini double, ks double"
_CELLS = "f int, cell bigint, low bigint, high bigint, pos bigint, neg bigint"


def _put_together(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Totals of the parts of each group, taken in `order`: pos, neg, the area so
    far and the extremes of the distance between the two distributions, each part
    shifted by what lies before it."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    placed = parts.withColumn("bn", F.coalesce(F.sum("neg").over(before), none)).withColumn("bp", F.coalesce(F.sum("pos").over(before), none))
    shift = F.try_divide("bn", "q") - F.try_divide("bp", "p")
    return placed.groupBy(*by).agg(
        F.max("p").alias("p"), F.max("q").alias("q"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(col("area") + col("pos").cast("double") * col("bn")).alias("area"),
        F.max(col("high") + shift).alias("high"), F.min(col("low") + shift).alias("low"),
    )


class _Held:
    """Rows (cell, low, high, pos, neg) of one feature in a task, added up by cell as they become many."""

    def __init__(self):
        self.lots: list[np.ndarray] = []
        self.size = 0

    def add(self, bits: np.ndarray, y: np.ndarray, known: int) -> None:
        order = np.argsort(bits)
        bits, y = bits[order], y[order]
        cell = bits >> (64 - known)
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        stop = np.r_[start[1:], len(cell)]
        pos = np.add.reduceat(y, start)
        self.put(np.stack([cell[start], bits[start], bits[stop - 1], pos, stop - start - pos]))

    def put(self, lot: np.ndarray) -> None:
        self.lots.append(lot)
        self.size += lot.shape[1]

    def take_back(self, lot: np.ndarray) -> None:
        self.lots, self.size = [lot], lot.shape[1]

    def take(self) -> np.ndarray:
        if not self.size:
            return np.empty((5, 0), np.int64)
        rows = np.concatenate(self.lots, axis=1)
        self.lots, self.size = [], 0
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        low, high = np.minimum.reduceat(rows[1], start), np.maximum.reduceat(rows[2], start)
        return np.stack([rows[0, start], low, high, np.add.reduceat(rows[3], start), np.add.reduceat(rows[4], start)])


def _too_many(held: list[_Held]) -> Iterator[int]:
    """Features to be handed on, those with most first, until what is left is no more than half of HELD."""
    size = sum(h.size for h in held)
    if size <= HELD:
        return
    for one in held:
        one.take_back(one.take())
    left = {f: h.size for f, h in enumerate(held)}
    for f in sorted(left, key=lambda f: -left[f]):
        if sum(left.values()) <= HELD // 2:
            return
        left[f] = 0
        yield f


def _inside(bits: np.ndarray, cells: np.ndarray, known: int) -> np.ndarray:
    """Where the first `known` bits are among the cells (ascending)."""
    if not len(cells):
        return np.zeros(len(bits), bool)
    cell = bits >> (64 - known)
    at = np.searchsorted(cells, cell)
    return (at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == cell)


def _counted(narrow: DataFrame, k: int, wanted: int, known: int, cells: list[np.ndarray] | None) -> DataFrame:
    """Cells of the first `wanted` bits, of the values inside `cells` (of `known` bits), all if None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [_Held() for _ in range(k)]
        for batch in batches:
            label = batch["y"].to_numpy(dtype="int64")
            for f in range(k):
                x = batch.iloc[:, f].to_numpy(dtype="float64")
                seen = ~np.isnan(x)
                bits, y = ordered_bits(x[seen]), label[seen]
                if cells is not None:
                    mine = _inside(bits, cells[f], known)
                    bits, y = bits[mine], y[mine]
                if len(bits):
                    held[f].add(bits, y, wanted)
            for f in _too_many(held):
                yield _frame(f, held[f].take())
        for f in range(k):
            if held[f].size:
                yield _frame(f, held[f].take())

    counted = narrow.mapInPandas(run, _CELLS)
    return counted.groupBy("f", "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def _frame(f: int, rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"f": np.full(rows.shape[1], f, np.int32), **dict(zip(("cell", "low", "high", "pos", "neg"), rows))})


_VALUES = "f int, cell bigint, bits bigint, pos bigint, neg bigint"


def _ranked_cells(narrow: DataFrame, k: int, known: int, cells: list[np.ndarray], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Parts of mixed cells (of `known` bits, each of a bounded number of rows): their
    distinct values, put in order. Tasks hand on what they hold; Spark adds it up and sorts it."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [_Held() for _ in range(k)]

        def out(f: int) -> pd.DataFrame:
            bits, _, _, pos, neg = held[f].take()
            return pd.DataFrame({"f": np.full(len(bits), f, np.int32), "cell": bits >> (64 - known), "bits": bits, "pos": pos, "neg": neg})

        for batch in batches:
            label = batch["y"].to_numpy(dtype="int64")
            for f in range(k):
                if not len(cells[f]):
                    continue
                x = batch.iloc[:, f].to_numpy(dtype="float64")
                seen = ~np.isnan(x)
                bits, y = ordered_bits(x[seen]), label[seen]
                mine = _inside(bits, cells[f], known)
                if mine.any():
                    held[f].add(bits[mine], y[mine], 64)
            for f in _too_many(held):
                yield out(f)
        for f in range(k):
            if held[f].size:
                yield out(f)

    # Dealt out by cell, so that the sums by value and their order need no other shuffle.
    dealt = narrow.mapInPandas(values, _VALUES).repartition("f", "cell")
    summed = dealt.groupBy("f", "cell", "bits").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    upto = Window.partitionBy("f", "cell").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
    p, q = (F.element_at(F.create_map(*[F.lit(v) for f, t in totals.items() for v in (f, t[i])]), col("f")) for i in (0, 1))
    placed = summed.withColumn("before", F.sum("neg").over(upto)).withColumn("gap", col("before") / q - F.sum("pos").over(upto) / p)
    return placed.groupBy("f", "cell").agg(
        F.min("bits").alias("place"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(col("pos") * (col("before") - col("neg") / 2.0)).alias("area"), F.max("gap").alias("high"), F.min("gap").alias("low"),
    ).drop("cell")


def _rank_metrics(df: DataFrame, scores: dict[str, Column], y: Column, rows: int = RANKED_ROWS) -> DataFrame:
    """One result row per score that is present in some row with a label."""
    spark, names = df.sparkSession, list(scores)
    narrow = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(scores.values())], y.alias("y")).where("y is not null")
    k, known, cells, parts, kept = len(names), 0, None, [], []
    totals: dict[int, tuple[int, int]] = {}
    try:
        for wanted in STEPS:
            counted = _counted(narrow, k, wanted, known, cells).persist()
            kept.append(counted)
            mixed = (col("pos") > 0) & (col("neg") > 0) & (col("low") < col("high"))
            size = col("pos") + col("neg")
            # At most 2 ** 20 cells of a feature in the first count; later ones only hold cells of more than `rows` rows.
            found = counted.groupBy("f").agg(
                F.sum("pos").alias("p"), F.sum("neg").alias("q"),
                F.collect_list(F.when(mixed & (size <= rows), col("cell"))).alias("small"),
                F.collect_list(F.when(mixed & (size > rows), col("cell"))).alias("large"),
            ).collect()
            totals = totals or {r.f: (r.p, r.q) for r in found}
            none = F.lit(None).cast("double")
            parts.append(counted.where(~mixed).select(
                "f", col("low").alias("place"), "pos", "neg", (col("pos") * col("neg").cast("double") / 2.0).alias("area"),
                none.alias("high"), none.alias("low"),
            ))
            small, large = ({r.f: np.array(sorted(r[kind]), np.int64) for r in found} for kind in ("small", "large"))
            small, large = ([c.get(f, np.empty(0, np.int64)) for f in range(k)] for c in (small, large))
            if any(len(c) for c in small):
                parts.append(_ranked_cells(narrow, k, wanted, small, totals))
            known, cells = wanted, large
            if not any(len(c) for c in large):
                break
        if not totals:
            return spark.createDataFrame([], _RANKED)
        sums = F.broadcast(spark.createDataFrame([(f, names[f], p, q) for f, (p, q) in totals.items()], "f int, name string, p bigint, q bigint"))
        # A closed cell moves the distance of the two distributions in one direction only: its end is its extreme.
        end = F.try_divide("neg", "q") - F.try_divide("pos", "p")
        table = reduce(DataFrame.unionByName, parts).join(sums, "f").select(
            "name", F.shiftright("place", 44).alias("coarse"), "place", "p", "q", "pos", "neg", "area",
            F.coalesce("high", end).alias("high"), F.coalesce("low", end).alias("low"),
        )
        for by, order in ((["name", "coarse"], "place"), (["name"], "coarse")):
            table = _put_together(table, by, order)
        auc = F.try_divide("area", col("p").cast("double") * col("q"))
        result = table.select(
            "name", (col("p") + col("q")), "p", auc, 2.0 * auc - 1.0, F.greatest(F.abs("high"), F.abs("low")),
        ).collect()
        return spark.createDataFrame(result, _RANKED)
    finally:
        for counted in kept:
            counted.unpersist()


def rank_metrics(df: DataFrame, score: str, label: str, rows: int = RANKED_ROWS) -> DataFrame:
    """One row: n, events, auc, gini, ks of a score where high means event."""
    return _rank_metrics(df, {score: as_number(df, score)}, binary(df, label), rows).drop("name")


def auc_gini(df: DataFrame, score: str, label: str) -> DataFrame:
    return rank_metrics(df, score, label).select("n", "events", "auc", "gini")


def gini(df: DataFrame, score: str, label: str) -> float | None:
    """The Gini coefficient as a number, None when one class is absent."""
    return ginis(df, [score], label).get(score)


def ginis(df: DataFrame, scores: Sequence[str], label: str) -> dict[str, float | None]:
    """The Gini coefficient of several scores of the same rows, from the same scans."""
    return {r["feature"]: r["gini"] for r in single_feature_gini(df, scores, label).collect()}


def ks_statistic(df: DataFrame, score: str, label: str) -> DataFrame:
    """Largest distance between the score distributions of the two classes."""
    return rank_metrics(df, score, label).select("n", "ks")


def single_feature_gini(df: DataFrame, features: Sequence[str], label: str, rows: int = RANKED_ROWS) -> DataFrame:
    """(feature, n, auc, gini, ks) of every numeric feature taken as a score."""
    found = _rank_metrics(df, {c: as_number(df, c) for c in features}, binary(df, label), rows)
    return found.select(col("name").alias("feature"), "n", "auc", "gini", "ks")


def confusion_metrics(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Counts and ratios of a 0/1 prediction, from one aggregate. A NaN prediction
    is missing; values other than 0 and 1 are refused."""
    plain = df.withColumn(prediction, as_number(df, prediction)) if _is_float(df, prediction) else df
    known = plain.select(binary(plain, prediction).alias("p"), binary(plain, label).alias("y")).where("p is not null and y is not null")
    hit, event = col("p") == 1, col("y") == 1
    counts = known.agg(
        F.count_if(hit & event).alias("tp"), F.count_if(hit & ~event).alias("fp"),
        F.count_if(~hit & ~event).alias("tn"), F.count_if(~hit & event).alias("fn"),
    )
    tp, fp, tn, fn = (col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return counts.select(
        "tp", "fp", "tn", "fn",
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        ((recall + F.try_divide(tn, tn + fp)) / 2.0).alias("roc_auc"),
    )


def gini_hard(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Gini of 0/1 predictions: true positive rate less false positive rate."""
    return confusion_metrics(df, prediction, label).select(
        (2.0 * col("roc_auc") - 1.0).alias("gini"),
    )


def calibration_curve(df: DataFrame, probability: str, label: str, bins: int = 5) -> DataFrame:
    """(bin, n, mean_prob, event_rate) over equal-width probability bins. A NaN
    probability is missing; values outside [0, 1] are refused."""
    value = as_number(df, probability)
    error = F.concat(F.lit(f"column {probability!r} must hold probabilities; found "), value.cast("string"))
    p = F.when(value.isNull() | value.between(0.0, 1.0), value).otherwise(F.raise_error(error).cast("double"))
    place = F.least(F.floor(col("p") * bins), F.lit(bins - 1).cast("bigint")).cast("int")
    return (
        df.select(p.alias("p"), binary(df, label).alias("y")).where("p is not null and y is not null")
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("p").alias("mean_prob"), F.avg(col("y").cast("double")).alias("event_rate"))
    )


def _is_float(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("float", "double")
