"""Correlation and F statistics for many features in few passes.

Rules: a pair counts only where both values are present, and a statistic that
is undefined (constant column, no pairs, one class) is null, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.columns import as_number, col
from gradewell.operators.sums import exact_sum, middle, ranges

# Features per aggregate: each needs about a dozen running numbers.
COLUMNS_PER_PASS = 50
# Columns per aggregate of means.
MEANS_PER_PASS = 200
# Features whose pairs are correlated in one scan.
BLOCK = 500
# Share of the squares around a shift that must be spread, or the shift is moved to the mean.
CANCELLED = 1e-4
# Square of the relative spread up to which a column counts as constant.
CONSTANT = 1e-28
# Groups of tasks whose sums are added apart first.
TASK_GROUPS = 16


def _chunks(names: Sequence[str]) -> list[list[str]]:
    return [list(names[i:i + COLUMNS_PER_PASS]) for i in range(0, len(names), COLUMNS_PER_PASS)]


def _variance(value: Column) -> Column:
    """Population variance; exactly 0 for a constant, where adding up partial
    results may leave a rounding residue."""
    return F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(F.var_pop(value))


def label_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, n, corr, abs_corr): Pearson correlation of every feature with the label."""
    return correlation_with(df, list(features), label).withColumn("abs_corr", F.abs("corr"))


def class_moments(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, label, n, mean, var) over present values; var is the population variance."""
    frames = []
    for names in _chunks(features):
        part = df.where(col(label).isNotNull()).select(
            col(label).alias("__y"), *[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)]
        )
        entries = [
            F.struct(
                F.lit(name).alias("feature"), F.count(f"x{i}").alias("n"),
                F.avg(f"x{i}").alias("mean"), _variance(col(f"x{i}")).alias("var"),
            )
            for i, name in enumerate(names)
        ]
        frames.append(part.groupBy("__y").agg(F.array(*entries).alias("__rows")).select(
            col("__y").alias("label"), F.inline("__rows")
        ))
    return reduce(DataFrame.unionByName, frames)


def f_from_moments(moments: DataFrame) -> DataFrame:
    """One-way ANOVA F per feature from its class moments."""
    present = moments.where("n > 0")
    grand = present.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("classes"),
        # spread of the class means around the grand mean, weighted by n
        F.collect_list(F.struct(col("n").cast("double").alias("n"), "mean")).alias("groups"),
        F.sum(col("n") * col("var")).alias("within"),
    )
    mean = F.aggregate("groups", F.lit(0.0), lambda a, g: a + g["n"] * g["mean"]) / col("n")
    grand = grand.withColumn("mean", mean)
    between = F.aggregate(
        "groups", F.lit(0.0), lambda a, g: a + g["n"] * (g["mean"] - col("mean")) * (g["mean"] - col("mean"))
    )
    f_value = F.try_divide(
        F.try_divide(between, col("classes") - 1), F.try_divide(col("within"), col("n") - col("classes"))
    )
    return grand.select("feature", "n", f_value.alias("f"))


def f_statistic(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, n, f): one-way ANOVA F of each feature between the label's classes."""
    return f_from_moments(class_moments(df, features, label))


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, var): population variance over present values."""
    frames = []
    for names in _chunks(features):
        part = df.select(*[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)])
        entries = [
            F.struct(F.lit(name).alias("feature"), _variance(col(f"x{i}")).alias("var")) for i, name in enumerate(names)
        ]
        frames.append(part.agg(F.array(*entries).alias("__rows")).select(F.inline("__rows")))
    return reduce(DataFrame.unionByName, frames)


def pairwise_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, n, corr) for every pair a before b in list order.

    One scan for up to BLOCK features; more are taken in pairs of blocks, a scan
    each, because a task holds the sums of all its pairs.
    """
    features = list(features)
    blocks = [np.arange(i, min(i + BLOCK, len(features))) for i in range(0, len(features), BLOCK)]
    shift = _column_means(df, features)
    tables = []
    for a, left in enumerate(blocks):
        for right in blocks[a:]:
            tables.append(_correlations(df, features, left, right, shift).where("i < j"))
    names = F.array(*[F.lit(c) for c in features])
    table = reduce(DataFrame.unionByName, tables)
    return table.select(names[col("i")].alias("feature_a"), names[col("j")].alias("feature_b"), "n", "corr")


def correlation_with(df: DataFrame, features: Sequence[str], other: str) -> DataFrame:
    """(feature, n, corr) of every feature with one numeric column."""
    return correlation_sets(df, features, other)[0]


def correlation_sets(df: DataFrame, features: Sequence[str], other: str, fold_col: str | None = None, folds: int = 0) -> list[DataFrame]:
    """(feature, n, corr) of every feature with one numeric column; with folds for every
    training set, all rows but those of fold 0, 1, ....

    One scan for the ends of the columns, one aggregate for every
    COLUMNS_PER_PASS features for their sums around the middle, and another for
    features whose mean is so far from it that squares cancel. Rows are added up
    once, by fold, and a set's sums are those of its folds, so the scans do not depend
    on their number. The sums are exact (see `sums`): the same to the last bit in any layout.
    """
    features, sets = list(features), range(max(folds, 1))
    present = df.where(as_number(df, other).isNotNull())
    spans = ranges(present, [*dict.fromkeys([*features, other])])
    shifts = {c: middle(span) for c, span in spans.items()}
    found: list[dict[str, tuple[int, float | None]]] = [{c: (0, None) for c in features} for _ in sets]
    todo = [c for c in features if spans[c][0] and shifts[c] is not None and shifts[other] is not None]
    if not folds:
        found[0] |= {c: (spans[c][0], None) for c in features if c not in todo}
    for again in (False, True):
        far = []
        for names in _chunks(todo):
            by_fold = _pair_sums(present, names, other, shifts, spans, fold_col)
            for i, c in enumerate(names):
                sums = [
                    [sum(part) for part in zip(*[by_fold[g][i] for g in sorted(by_fold) if not folds or g != t])] or [0] * 6 for t in sets
                ]
                if not again and any(n and sxx > 0 and sxx - sx * sx / n < sxx * CANCELLED for n, sx, _, sxx, _, _ in sums):
                    far.append(c)
                    n, sx = (sum(by_fold[g][i][k] for g in sorted(by_fold)) for k in (0, 1))
                    shifts[c] += sx / n
                    continue
                for t in sets:
                    found[t][c] = int(sums[t][0]), _from_sums(sums[t], shifts[c], shifts[other])
        todo = far
    return [
        df.sparkSession.createDataFrame([(c, *one[c]) for c in features], "feature string, n bigint, corr double") for one in found
    ]


def _pair_sums(df: DataFrame, features: Sequence[str], other: str, shifts: dict[str, float], spans: dict,
               fold_col: str | None) -> dict[int, list[tuple[float, ...]]]:
    """By fold (0 without): n, sx, sy, sxx, syy, sxy of every feature with `other`, around their shifts, where both are present."""
    rows = spans[other][0]
    reach = {c: max(abs(spans[c][1] - shifts[c]), abs(spans[c][2] - shifts[c])) for c in {*features, other}}
    b = reach[other]
    part = df.select((as_number(df, other) - F.lit(shifts[other])).alias("y"), *[
        (as_number(df, c) - F.lit(shifts[c])).alias(f"x{i}") for i, c in enumerate(features)
    ], *([col(fold_col).cast("int").alias("g")] if fold_col else []))
    entries = []
    for i, c in enumerate(features):
        x, a = col(f"x{i}"), reach[c]
        y = col("y") if spans[c][0] == rows else F.when(x.isNotNull(), col("y"))
        sums = {"a": (x, a), "b": (y, b), "aa": (x * x, a * a), "bb": (y * y, b * b), "ab": (x * y, a * b)}
        entries.append(F.count(x).alias(f"n{i}"))
        entries += [F.coalesce(exact_sum(value, bound, rows), F.lit(0.0)).alias(f"{k}{i}") for k, (value, bound) in sums.items()]
    found = (part.groupBy("g") if fold_col else part.groupBy(F.lit(0).alias("g"))).agg(*entries).collect()  # one row per fold
    return {r["g"]: [tuple(r[f"{k}{i}"] for k in ("n", "a", "b", "aa", "bb", "ab")) for i in range(len(features))] for r in found}


def _from_sums(sums: tuple[float, ...], shift_x: float, shift_y: float) -> float | None:
    n, sx, sy, sxx, syy, sxy = sums
    if not n:
        return None
    cxx, cyy, cxy = sxx - sx * (sx / n), syy - sy * (sy / n), sxy - sx * (sy / n)
    ax, ay = abs(sx / n + shift_x), abs(sy / n + shift_y)
    # A spread within the rounding of the values themselves is a constant column.
    if not (cxx > n * ax * ax * CONSTANT and cyy > n * ay * ay * CONSTANT):
        return None
    corr = cxy / (math.sqrt(cxx) * math.sqrt(cyy))
    return corr if math.isfinite(corr) else None


def _column_means(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """About the mean of every column (0 if it has none): a shift near the middle
    keeps the squares that follow from cancelling. Rounded, as its last digits do not matter."""
    shift = []
    for names in [list(columns[i : i + MEANS_PER_PASS]) for i in range(0, len(columns), MEANS_PER_PASS)]:
        row = df.select(*[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)]).agg(
            *[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names))]
        ).first()
        shift += [float(np.float32(v)) if v is not None and np.isfinite(np.float32(v)) else 0.0 for v in row]
    return np.array(shift)




_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _correlations(df: DataFrame, columns: Sequence[str], left: np.ndarray, right: np.ndarray, shift: np.ndarray) -> DataFrame:
    """(i, j, n, corr) of every column in `left` with every one in `right`.

    A task folds its rows, less the shift all tasks share, into masked sums with
    matrix products and hands on one row of arrays per left column. Those are
    added up, spread by column and a number of groups of tasks first; all of it
    are plain sums.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, len(left), len(right)))
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            seen = ~np.isnan(x)
            x = np.where(seen, x - shift, 0.0)
            m = seen.astype("float64")
            a, b, ma, mb = x[:, left], x[:, right], m[:, left], m[:, right]
            sums += np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])
        yield pd.DataFrame({"i": left.astype("int32")} | {name: list(v) for name, v in zip(_SUMS, sums)})

    narrow = df.select(*[as_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    packed = narrow.mapInPandas(fold, "i int, " + ", ".join(f"{name} array<double>" for name in _SUMS))
    dealt = packed.withColumn("g", F.spark_partition_id() % TASK_GROUPS).repartition("i", "g")
    pairs = dealt.select("i", "g", F.posexplode(F.arrays_zip(*_SUMS)).alias("at", "s")).select("i", "g", "at", "s.*")
    added = [F.sum(name).alias(name) for name in _SUMS]
    total = pairs.groupBy("i", "at", "g").agg(*added).groupBy("i", "at").agg(*added)
    places, means = F.array(*[F.lit(int(j)) for j in right]), F.array(*[F.lit(float(v)) for v in shift])
    total = total.withColumn("j", places[col("at")]).withColumns({
        "mx": F.try_divide("sx", "n"), "my": F.try_divide("sy", "n"),
    })
    total = total.withColumns({
        "cxx": col("sxx") - col("sx") * col("mx"), "cyy": col("syy") - col("sy") * col("my"), "cxy": col("sxy") - col("sx") * col("my"),
        "ax": F.abs(col("mx") + means[col("i")]), "ay": F.abs(col("my") + means[col("j")]),
    })
    # A spread within the rounding of the values themselves is a constant column.
    varies = (col("cxx") > col("n") * col("ax") * col("ax") * CONSTANT) & (col("cyy") > col("n") * col("ay") * col("ay") * CONSTANT)
    corr = F.try_divide(col("cxy"), F.sqrt("cxx") * F.sqrt("cyy"))
    return total.select("i", "j", col("n").cast("bigint").alias("n"), F.when(varies & ~F.isnan(corr), corr).alias("corr"))
