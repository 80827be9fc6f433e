"""Quantile edges of many numeric features, exact and independent of the layout.

Doubles map to 64-bit integers in the same order. Three scans narrow the wanted
ranks down by counting leading bits: first 20 of them, which is a few hundred
cells between a number and its double, then, inside the cells that hold a
wanted rank, 12 more, then the rest. Counts add up, so tasks hand on one number
per cell and all reducers share them; no sketch and no single merging task.
All features are counted in the same scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import as_number, col

# Leading bits known after each scan.
STEPS = (20, 32, 64)
# Cells, of all features and folds together, that a task holds before it hands them on.
HELD = 1 << 18


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles; 0.0 and -0.0 are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).astype(np.int64).view(np.float64)


def _added(lots: list[np.ndarray]) -> np.ndarray:
    """Counts (cell, n) added up by cell."""
    cell, n = np.concatenate(lots, axis=1)
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return np.stack([cell[start], np.add.reduceat(n, start)])


def _counted_cells(batches: Iterator[pd.DataFrame], k: int, known: int, wanted: int, cells: list[np.ndarray] | None,
                   folds: int) -> Iterator[pd.DataFrame]:
    """The counts of a task, added up over its batches and handed on when they are more than HELD."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = 0

    def frame() -> pd.DataFrame:
        g, f, counts = zip(*((g, f, _added(lots)) for (f, g), lots in held.items()))
        rows = [c.shape[1] for c in counts]
        cell, n = np.concatenate(counts, axis=1)
        parent = cell >> (wanted - known) if known else np.zeros(len(cell), np.int64)
        return pd.DataFrame({"g": np.repeat(g, rows), "f": np.repeat(f, rows), "parent": parent, "cell": cell, "n": n})

    for batch in batches:
        fold = batch["g"].to_numpy()
        for f in range(k):
            x = batch.iloc[:, f].to_numpy(dtype="float64")
            seen = ~np.isnan(x)
            bits, own = ordered_bits(x[seen]), fold[seen]
            if cells is not None:
                inside = np.isin(bits >> (64 - known), cells[f])
                bits, own = bits[inside], own[inside]
            for g in range(max(folds, 1)):
                counts = np.stack(np.unique((bits[own == g] if folds else bits) >> (64 - wanted), return_counts=True))
                if counts.shape[1]:
                    held.setdefault((f, g), []).append(counts)
                    size += counts.shape[1]
        if size > HELD:
            held = {key: [_added(lots)] for key, lots in held.items()}
            size = sum(lots[0].shape[1] for lots in held.values())
            if size > HELD // 2:
                yield frame()
                held, size = {}, 0
    if held:
        yield frame()


def _cell_counts(df: DataFrame, names: Sequence[str], known: int, wanted: int, cells: list[np.ndarray] | None,
                 fold_col: str | None = None, folds: int = 0) -> DataFrame:
    """(t, f, parent, cell, n): values counted by their first `wanted` bits, of those
    values whose first `known` bits (parent) are among cells[f]; all if None. Rows are
    counted once, by fold; training set t has the rows of all folds but t."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _counted_cells(batches, len(names), known, wanted, cells, folds)

    fold = col(fold_col).cast("int") if fold_col else F.lit(0)
    narrow = df.select(*[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)], fold.alias("g"))
    counted = narrow.mapInPandas(count, "g int, f int, parent long, cell long, n long")
    if not folds:
        return counted.groupBy(col("g").alias("t"), "f", "parent", "cell").agg(F.sum("n").alias("n"))
    by_fold = counted.groupBy("g", "f", "parent", "cell").agg(F.sum("n").alias("n"))
    others = F.explode(F.array_remove(F.array(*[F.lit(t) for t in range(folds)]), col("g")))
    return by_fold.withColumn("t", others).groupBy("t", "f", "parent", "cell").agg(F.sum("n").alias("n"))


def _first_cells(counts: DataFrame, bins: Sequence[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(t, f, cell, b, i, rank within the cell) of the cell that holds rank ceil(i * n / b) of a training set's values."""
    set_of = Window.partitionBy("t", "f")
    running = counts.withColumn("upto", F.sum("n").over(set_of.orderBy("cell"))).withColumn("size", F.sum("n").over(set_of))
    asked = running.withColumn("b", F.explode(F.array(*[F.lit(int(b)).cast("bigint") for b in bins])))
    first, last = F.expr("(upto - n) * b div size + 1"), F.expr("upto * b div size")
    hits = asked.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    inside = F.expr("(i * size + b - 1) div b - (upto - n)")
    return [tuple(r) for r in hits.select("t", "f", "cell", "b", "i", inside.alias("inside")).collect()]


def _holding(counts: DataFrame, asked: list[tuple[int, int, int, int]]) -> dict[tuple[int, int, int, int], tuple[int, int]]:
    """(t, f, parent, rank within parent) -> (cell, rank within cell) of the cell that holds it."""
    if not asked:
        return {}
    targets = counts.sparkSession.createDataFrame(asked, "t int, f int, parent long, rank long")
    running = F.sum("n").over(Window.partitionBy("t", "f", "parent").orderBy("cell"))
    hits = (
        counts.withColumn("upto", running).join(F.broadcast(targets), ["t", "f", "parent"])
        .where((col("rank") <= col("upto")) & (col("rank") > col("upto") - col("n")))
    )
    return {(r.t, r.f, r.parent, r.rank): (r.cell, r.inside) for r in hits.select(
        "t", "f", "parent", "rank", "cell", (col("rank") - col("upto") + col("n")).alias("inside")
    ).collect()}


def fold_edges(df: DataFrame, features: Sequence[str], bins: Sequence[int], fold_col: str | None = None, folds: int = 0,
               exact: bool = True) -> list[dict[int, dict[str, list[float]]]]:
    """The edges of quantile_edges for several numbers of bins and, with folds, for
    every training set (all rows but those of fold 0, 1, ...), from the same three
    scans: one [training set][number of bins][feature]."""
    features, bins = list(features), sorted(set(bins))
    steps = STEPS if exact else STEPS[:-1]
    counts = _cell_counts(df, features, 0, steps[0], None, fold_col, folds)
    # (t, f, b, i) -> (cell that holds the rank, rank within the cell)
    places = {(t, f, b, i): (cell, inside) for t, f, cell, b, i, inside in _first_cells(counts, bins)}
    for known, wanted in zip(steps, steps[1:]):
        cells = [np.array(sorted({cell for (_, g, _, _), (cell, _) in places.items() if g == f}), np.int64) for f in range(len(features))]
        asked = sorted({(t, f, cell, inside) for (t, f, _, _), (cell, inside) in places.items()})
        found = _holding(_cell_counts(df, features, known, wanted, cells, fold_col, folds), asked)
        places = {(t, f, b, i): found[t, f, cell, inside] for (t, f, b, i), (cell, inside) in places.items()}
    rest = 64 - steps[-1]
    held: dict[tuple[int, int, int], set[int]] = {}
    for (t, f, b, _), (cell, _) in places.items():
        held.setdefault((t, f, b), set()).add(cell)

    def edges(t: int, f: int, b: int) -> list[float]:
        bits = (np.array(sorted(held.get((t, f, b), ())), np.int64) << rest) | np.int64((1 << rest) - 1)
        return [float(v) for v in from_bits(bits)[:-1]]  # the last one holds the maximum

    return [{b: {name: edges(t, f, b) for f, name in enumerate(features)} for b in bins} for t in range(max(folds, 1))]


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 20, exact: bool = True) -> dict[str, list[float]]:
    """Up to bins - 1 ascending edges per feature: the values at ranks
    ceil(i * n / bins), repeats and the maximum left out, so that every
    interval (edge, next edge] holds rows. exact=False saves the last scan and
    takes the upper end of the cell, less than a millionth above the value."""
    return fold_edges(df, features, [bins], exact=exact)[0][bins]


def woe_prebin(df: DataFrame, features: Sequence[str], bins: int = 20, exact: bool = True) -> DataFrame:
    """(feature, edge_no, edge): the pre-bin edges as a table, one row per edge."""
    edges = quantile_edges(df, features, bins, exact)
    rows = [(c, i, float(e)) for c in features for i, e in enumerate(edges[c])]
    return df.sparkSession.createDataFrame(rows, "feature string, edge_no int, edge double")
