"""Feature selection.

The work on rows is one correlation pass, one F pass or both; what remains is a
choice among features on a table of features or feature pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import classify_columns, col
from gradewell.operators.stats import BLOCK, correlation_with, f_statistic, label_correlation, pairwise_correlation, variances

# Lowest mean correlation a relevance is divided by.
REDUNDANCY_FLOOR = 0.001
# Digits that count in a comparison: what differs beyond them is a tie and goes to the first name.
DIGITS = 12


def significant(value: float) -> float:
    """value to DIGITS significant digits."""
    return float(f"{value:.{DIGITS - 1}e}")


def _by_correlation(df: DataFrame, numeric: Sequence[str], label: str, known: DataFrame | None = None) -> DataFrame:
    """(rank, feature, abs_corr, defined) for features with a defined correlation, ties to DIGITS decimals by name."""
    if known is None:
        known = label_correlation(df, numeric, label)
    table = known.where(col("corr").isNotNull() & col("feature").isin(list(numeric))).withColumn("abs_corr", F.abs("corr"))
    # One row per feature: a single window is small whatever the data.
    order = Window.partitionBy(F.lit(1)).orderBy(F.round("abs_corr", DIGITS).desc(), "feature")
    return table.select(
        F.row_number().over(order).alias("rank"), "feature", "abs_corr",
        F.count("*").over(Window.partitionBy(F.lit(1))).alias("defined"),
    )


def low_corr_filter(df: DataFrame, numeric: Sequence[str], label: str) -> DataFrame:
    """The third of the numeric features most correlated with the label (rounded
    down): (rank, feature, abs_corr)."""
    ranked = _by_correlation(df, numeric, label)
    return ranked.where(col("rank") <= F.floor(col("defined") / 3)).drop("defined")


def top_corr_select(df: DataFrame, features: Sequence[str], label: str, top_share: float = 0.3,
                    known: DataFrame | None = None) -> DataFrame:
    """The top share (at least one) of the numeric features by |correlation|,
    then every categorical feature: (rank, feature, kind, abs_corr). `known` has
    the correlations (feature, n, corr) already."""
    numeric, categorical = classify_columns(df, features)
    chosen = df.sparkSession.createDataFrame(
        [(i, c, "categorical", None) for i, c in enumerate(categorical, 1)],
        "place int, feature string, kind string, abs_corr double",
    )
    if numeric:
        ranked = _by_correlation(df, numeric, label, known)
        keep = F.greatest(F.lit(1), F.floor(col("defined") * F.lit(float(top_share))).cast("int"))
        chosen = chosen.unionByName(ranked.where(col("rank") <= keep).select(
            col("rank").alias("place"), "feature", F.lit("numeric").alias("kind"), "abs_corr"
        ))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("kind"), "place")
    return chosen.select(F.row_number().over(order).alias("rank"), "feature", "kind", "abs_corr")


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float) -> dict[str, set[str]]:
    """For every feature those that correlate with it beyond the threshold. Only
    such pairs come to the driver."""
    near: dict[str, set[str]] = {c: set() for c in features}
    if len(features) > 1:
        for r in pairwise_correlation(df, features).where(F.abs("corr") > threshold).select("feature_a", "feature_b").collect():
            near[r["feature_a"]].add(r["feature_b"])
            near[r["feature_b"]].add(r["feature_a"])
    return near


def _keep_first(order: Sequence[str], near: dict[str, set[str]]) -> set[str]:
    """Walk the features in order; keep one unless it correlates with one kept."""
    kept: set[str] = set()
    for c in order:
        if not near[c] & kept:
            kept.add(c)
    return kept


def _kept_table(df: DataFrame, features: Sequence[str], kept: set[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, c in kept) for c in features], "feature string, kept boolean")


def drop_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """(feature, kept): of correlated features the earliest in the list stays."""
    features = list(features)
    return _kept_table(df, features, _keep_first(features, correlated_pairs(df, features, threshold)))


def smart_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """(feature, kept): of correlated features the one of highest variance stays."""
    features = list(features)
    spread = {r["feature"]: -1.0 if r["var"] is None else r["var"] for r in variances(df, features).collect()}
    order = sorted(features, key=lambda c: (-significant(spread[c]), c))
    return _kept_table(df, features, _keep_first(order, correlated_pairs(df, features, threshold)))


def kept_features(table: DataFrame) -> list[str]:
    """The kept features of one of the two tables above."""
    return [r["feature"] for r in table.where("kept").select("feature").collect()]


def greedy_mrmr(relevance: dict[str, float | None], correlations: Callable[[str, Sequence[str]], dict[str, float]], k: int) -> list[tuple[str, float]]:
    """Take the most relevant feature, then repeatedly the one with the largest
    relevance / mean |corr| to those taken. Ties go to the first name.
    correlations(taken, others) gives |corr|, 0 where it is undefined."""
    left = sorted(c for c, value in relevance.items() if value is not None)
    sums = dict.fromkeys(left, 0.0)
    chosen: list[tuple[str, float]] = []
    while left and len(chosen) < k:
        scores = {c: relevance[c] / max(sums[c] / len(chosen), REDUNDANCY_FLOOR) if chosen else relevance[c] for c in left}
        best = max(left, key=lambda c: significant(scores[c]))
        chosen.append((best, scores[best]))
        left.remove(best)
        if left and len(chosen) < k:
            for c, value in correlations(best, left).items():
                sums[c] += value
    return chosen


def mrmr_select(df: DataFrame, features: Sequence[str], label: str, k: int) -> DataFrame:
    """(rank, feature, score): k features by minimum redundancy, maximum relevance (FCQ).

    The correlations of all pairs come from one scan if they fit it; with more
    than BLOCK features those with each chosen one are a scan of their own.
    """
    features = list(features)
    spark = df.sparkSession
    relevance = dict.fromkeys(features) | {r["feature"]: r["f"] for r in f_statistic(df, features, label).collect()}
    labelled = df.where(col(label).isNotNull())
    if len(features) <= BLOCK:
        rows = pairwise_correlation(labelled, features).select("feature_a", "feature_b", "corr").collect() if len(features) > 1 else []
        known = {frozenset((r["feature_a"], r["feature_b"])): abs(round(r["corr"] or 0.0, DIGITS)) for r in rows}

        def correlations(taken: str, others: Sequence[str]) -> dict[str, float]:
            return {c: known[frozenset((taken, c))] for c in others}
    else:
        def correlations(taken: str, others: Sequence[str]) -> dict[str, float]:
            rows = correlation_with(labelled, others, taken).collect()
            return {r["feature"]: abs(round(r["corr"] or 0.0, DIGITS)) for r in rows}

    chosen = greedy_mrmr(relevance, correlations, k)
    rows = [(i, c, float(s)) for i, (c, s) in enumerate(chosen, 1)]
    return spark.createDataFrame(rows, "rank int, feature string, score double")
