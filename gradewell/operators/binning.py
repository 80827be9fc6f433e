"""Weight-of-evidence binning: fit, tables, transform, save and load.

A fitted binning is a plain table with one row per feature and bin. Numeric
bins are (lo, hi] with open ends; every category is a bin; missing values (null
or NaN) have a bin of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gradewell.columns import as_number, binary, classify_columns, col
from gradewell.functions.weights import bin_measures
from gradewell.operators.monotone import best_partition, woe_monotone
from gradewell.operators.quantiles import fold_edges
from gradewell.workspace import attach, pinned

# Up to this many categories are looked up in a literal map, more by a join.
MAP_CATEGORIES = 64
# From this many numeric features on, Arrow batches beat per-feature JVM lookups.
ARROW_FEATURES = 16

_COUNTS = "feature string, bin int, n long, events long"


@dataclass(frozen=True)
class NumericBins:
    """One numeric feature: ascending edges, WoE per bin, WoE of the missing bin."""

    edges: tuple[float, ...]
    woe: tuple[float, ...]
    missing: float


@dataclass(frozen=True)
class Binning:
    """A fitted binning. `table` has one row per feature and bin; `numeric` is
    its numeric part as lookup arrays; `categorical` names the other features."""

    table: DataFrame
    numeric: dict[str, NumericBins]
    categorical: tuple[str, ...]

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Binning:
        table = spark.read.parquet(path)
        names = table.where("kind = 'categorical'").select("feature").distinct().collect()
        return _binning(table, sorted(r["feature"] for r in names))


def _binning(table: DataFrame, categorical: Sequence[str]) -> Binning:
    """Lookup arrays out of a bin table. Only its numeric rows, a bounded
    number per feature, come to the driver."""
    rows: dict[str, list[Row]] = {}
    for r in table.where("kind = 'numeric'").select("feature", "bin", "hi", "woe").collect():
        rows.setdefault(r["feature"], []).append(r)
    numeric = {}
    for name, mine in rows.items():
        spans = sorted((r for r in mine if r["bin"] is not None), key=lambda r: r["bin"])
        missing = [r["woe"] for r in mine if r["bin"] is None]
        numeric[name] = NumericBins(
            tuple(r["hi"] for r in spans[:-1]), tuple(r["woe"] or 0.0 for r in spans), (missing[0] or 0.0) if missing else 0.0
        )
    return Binning(table, numeric, tuple(categorical))


def numeric_counts(df: DataFrame, label: str, edges: dict[str, list[float]], fold_col: str | None = None, folds: int = 0) -> DataFrame:
    """(fold, feature, bin, n, events) per bin of every numeric feature, bin null for
    missing, fold 0 for all rows without folds. A task adds its rows up in small
    arrays; only those are shuffled."""
    names = list(edges)
    cuts = [np.array(edges[c], dtype="float64") for c in names]
    k = max(folds, 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((len(c) + 2, k, 2), dtype="int64") for c in cuts]
        for batch in batches:
            y = batch["y"].to_numpy(dtype="int64") + 2 * batch["g"].to_numpy(dtype="int64")
            for f, cut in enumerate(cuts):
                x = batch.iloc[:, f].to_numpy(dtype="float64")
                slot = np.where(np.isnan(x), len(cut) + 1, np.searchsorted(cut, x, "left"))
                sums[f] += np.bincount(slot * 2 * k + y, minlength=sums[f].size).reshape(sums[f].shape)
        for f, name in enumerate(names):
            bins = pd.array([*range(len(cuts[f]) + 1), None], dtype="Int32")
            for g in range(k):
                n = sums[f][:, g].sum(axis=1)
                yield pd.DataFrame({"fold": g, "feature": name, "bin": bins, "n": n, "events": sums[f][:, g, 1]})[n > 0]

    narrow = df.where(col(label).isNotNull()).select(
        *[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)], binary(df, label).alias("y"),
        (col(fold_col).cast("int") if fold_col else F.lit(0)).alias("g"),
    )
    return (
        narrow.mapInPandas(count, f"fold int, {_COUNTS}").groupBy("fold", "feature", "bin")
        .agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    )


def category_counts(df: DataFrame, label: str, features: Sequence[str], fold_col: str | None = None) -> DataFrame:
    """(fold, feature, category, n, events) per category, category null for missing, fold 0 for all rows without folds."""
    values = [F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("category")) for c in features]
    fold = col(fold_col).cast("int") if fold_col else F.lit(0)
    return (
        df.where(col(label).isNotNull())
        .select(binary(df, label).alias("__y"), fold.alias("fold"), F.inline(F.array(*values)))
        .groupBy("fold", "feature", "category")
        .agg(F.count("*").alias("n"), F.sum("__y").alias("events"))
    )


def _with_measures(counts: DataFrame, all_events: int, all_non_events: int, keep: Sequence[str] = ()) -> DataFrame:
    non_events = col("n") - col("events")
    woe, iv = bin_measures(col("events"), non_events, all_events, all_non_events)
    return counts.select(
        "feature", "kind", "bin", "lo", "hi", "category",
        (col("bin").isNull() & col("category").isNull()).alias("is_missing"),
        "n", "events", non_events.alias("non_events"),
        F.try_divide(col("events").cast("double"), col("n")).alias("event_rate"), woe.alias("woe"), iv.alias("iv"), *keep,
    )


def fit_binning(df: DataFrame, features: Sequence[str], label: str, bins: int = 20, trend: str | None = None,
                min_share: float = 0.0, exact: bool = True, class_weight: str | None = None, max_bins: int | None = None,
                min_gap: float = 0.0, category_share: float | None = None) -> Binning:
    """Bin every feature against a 0/1 label (rows without a label are left out).

    trend: None keeps the quantile pre-bins; 'asc', 'desc', 'peak', 'valley',
    'auto_asc_desc' or 'auto' merges them into at most `max_bins` bins of at least
    `min_share` of the rows, whose neighbours differ by `min_gap` in WoE.
    category_share: None makes every category a bin; a share puts all categories
    with fewer rows into one, orders that and the others by event rate (ties by
    name, the pooled one first) and merges neighbours under the same constraints.
    class_weight='balanced' is accepted and changes nothing: one weight per class
    cancels in both shares of WoE.
    """
    option = {
        "bins": bins, "trend": trend, "min_share": min_share, "class_weight": class_weight, "max_bins": max_bins, "min_gap": min_gap,
        "category_share": category_share,
    }
    return fit_binnings(df, features, label, [option], exact=exact)[0][0]


def fit_binnings(df: DataFrame, features: Sequence[str], label: str, options: Sequence[dict], fold_col: str | None = None,
                 folds: int = 0, exact: bool = True) -> list[list[Binning]]:
    """Several binnings from the same scans: [training set][option].

    An option is a dict of the settings of fit_binning (but exact). With folds, training set i has all rows but those of fold i: rows are counted once,
    by fold, and a set's counts are the totals less its fold's. So the scans (three
    for edges, one for numeric counts, one for categories) do not depend on the
    number of folds or options.
    """
    for option in options:
        if option.get("class_weight") not in (None, "balanced"):
            raise ValueError(f"unknown class_weight {option['class_weight']!r}")
    numeric, categorical = classify_columns(df, features)
    if not numeric and not categorical:
        raise ValueError("no features to bin")
    labelled = df.where(col(label).isNotNull())
    sets = range(max(folds, 1))
    wanted = [int(option.get("bins", 20)) for option in options]
    edges = fold_edges(labelled, numeric, wanted, fold_col, folds, exact) if numeric else []
    # One count over the edges of all sets and options; a bin is a run of these narrower ones.
    union = {c: sorted({e for t in sets for b in wanted for e in edges[t][b][c]}) for c in numeric}
    # At most a few rows per feature, edge and fold; categories may be many and stay out there.
    narrow = numeric_counts(labelled, label, union, fold_col, folds).collect() if numeric else []
    categories = pinned(category_counts(labelled, label, categorical, fold_col)) if categorical else None
    if numeric:
        mine = [(r["fold"], r["n"], r["events"]) for r in narrow if r["feature"] == numeric[0]]
    else:
        one = categories.where(col("feature") == F.lit(categorical[0])).groupBy("fold").agg(F.sum("n"), F.sum("events"))
        mine = [tuple(r) for r in one.collect()]
    found = []
    for t in sets:
        used = [g for g in sets if not folds or g != t]
        # Every labelled row is in exactly one bin of any one feature.
        rows, events = (sum(r[k] for r in mine if r[0] in used) for k in (1, 2))
        totals = events, rows - events
        left = None
        if categories is not None:
            left = categories.where(col("fold") != t) if folds else categories
            left = left.groupBy("feature", "category").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
        found.append([])
        for option, b in zip(options, wanted):
            own = edges[t][b] if numeric else {}
            spans = _merged_counts([r for r in narrow if r["fold"] in used], union, own)
            found[-1].append(finished(df.sparkSession, spans, own, left, categorical, totals, option))
    return found


def _merged_counts(narrow: list[Row], union: dict[str, list[float]], edges: dict[str, list[float]]) -> list[tuple]:
    """(feature, bin, n, events) over `edges` from counts over the finer edges of `union`."""
    place = {c: np.searchsorted(edges[c], [*union[c], math.inf], "left").tolist() for c in edges}
    sums: dict[tuple, list[int]] = {}
    for r in narrow:
        # the narrow bin (previous edge, edge] lies in the bin that its upper end falls into
        at = None if r["bin"] is None else place[r["feature"]][r["bin"]]
        total = sums.setdefault((r["feature"], at), [0, 0])
        total[0] += r["n"]
        total[1] += r["events"]
    return [(*key, *total) for key, total in sums.items()]


def finished(spark: SparkSession, spans: list[tuple], edges: dict[str, list[float]], categories: DataFrame | None,
             categorical: Sequence[str], totals: tuple[int, int], option: dict) -> Binning:
    """The binning of counted bins (feature, bin, n, events) and categories (feature, category, n, events)."""
    limits = {k: option[k] for k in ("min_share", "max_bins", "min_gap") if option.get(k)}
    table = _with_measures(_numeric_table(spark, spans, edges, totals, option.get("trend"), limits), *totals)
    if categories is not None:
        named = categories.select("feature", F.lit("categorical").alias("kind"), "category", "n", "events")
        if option.get("category_share") is None:
            rows = _with_measures(_as_bins(named), *totals)
        else:
            rows = _grouped_categories(pinned(named), totals, option["category_share"], limits)
        table = table.unionByName(rows)
    return _binning(table, categorical)


def _as_bins(categories: DataFrame) -> DataFrame:
    return categories.withColumns({
        "bin": F.lit(None).cast("int"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"),
    })


def _grouped_categories(categories: DataFrame, totals: tuple[int, int], share: float, limits: dict) -> DataFrame:
    """Bin rows of categories that share bins, numbered by event rate: each with its own counts, the
    WoE of its bin and, by its rows, a part of the bin's IV. Only categories with at least `share` of
    the rows come to the driver, no more than 1 / share of a feature."""
    rows, spark = sum(totals), categories.sparkSession
    present, large = categories.where("category is not null"), col("n") >= share * rows
    pooled = present.where(~large).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    entries = present.where(large).unionByName(pooled.withColumns({"kind": F.lit("pooled"), "category": F.lit("")}))
    by_feature: dict[str, list[tuple]] = {}
    for r in entries.collect():
        by_feature.setdefault(r["feature"], []).append((r["kind"] != "pooled", r["category"], r["n"], r["events"]))
    places, bins = [], []
    for feature, found in by_feature.items():
        found.sort(key=lambda r: (Fraction(r[3], r[2]), r[0], r[1]))
        n, events = [r[2] for r in found], [r[3] for r in found]
        least = limits.get("min_share", 0.0) * rows
        _, starts = best_partition(events, n, *totals, "asc", least, limits.get("max_bins"), limits.get("min_gap", 0.0))
        for number, (low, high) in enumerate(zip(starts or [0], [*starts[1:], len(found)])):
            bins.append((feature, number, sum(n[low:high]), sum(events[low:high])))
            places += [(feature, number, category, own) for own, category, _, _ in found[low:high]]
    named = spark.createDataFrame([p[:3] for p in places if p[3]], "feature string, bin int, category string")
    rest = spark.createDataFrame([p[:2] for p in places if not p[3]], "feature string, rest int")
    sums = spark.createDataFrame(bins, "feature string, bin int, bin_n bigint, bin_events bigint")
    placed = attach(attach(categories, named, ["feature", "category"]), rest, ["feature"])
    placed = placed.withColumn("bin", F.when(col("category").isNotNull(), F.coalesce("bin", "rest"))).drop("rest")
    placed = attach(placed, sums, ["feature", "bin"])
    # The missing bin has no group: its own counts are the bin's.
    placed = placed.withColumns({
        "bin_n": F.coalesce("bin_n", "n"), "bin_events": F.coalesce("bin_events", "events"),
        "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"),
    })
    woe, iv = bin_measures(col("bin_events"), col("bin_n") - col("bin_events"), *totals)
    measured = _with_measures(placed, *totals, keep=["bin_n", "bin_events"])
    return measured.withColumns({"woe": woe, "iv": F.try_divide(col("n").cast("double"), col("bin_n")) * iv}).drop("bin_n", "bin_events")


def _numeric_table(spark: SparkSession, counts: list[tuple], edges: dict[str, list[float]], totals: tuple[int, int],
                   trend: str | None, limits: dict) -> DataFrame:
    """The counted bins with their ends, merged by trend if one is given."""
    merged = {}
    if trend and counts:
        spans = [r for r in counts if r[1] is not None]
        plan = woe_monotone(spark.createDataFrame(spans, _COUNTS), *totals, trend, **limits)
        merged = {(r["feature"], r["bin"]): r["merged"] for r in plan.collect()}
    rows: dict[tuple, list] = {}
    for name, place, n, events in sorted(counts, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        target = merged.get((name, place), place)
        ends = [-math.inf, *edges[name], math.inf]
        lo, hi = (ends[place], ends[place + 1]) if place is not None else (None, None)
        row = rows.setdefault((name, target), [name, "numeric", target, lo, hi, None, 0, 0])
        row[4] = hi
        row[6] += n
        row[7] += events
    return spark.createDataFrame(
        list(map(tuple, rows.values())),
        "feature string, kind string, bin int, lo double, hi double, category string, n bigint, events bigint",
    )


def woe_bins(df: DataFrame, features: Sequence[str], label: str, **options) -> DataFrame:
    """The bin table: counts, event rate, WoE and IV per feature and bin."""
    return fit_binning(df, features, label, **options).table


def iv_table(bins: DataFrame) -> DataFrame:
    """(feature, bins, iv) per feature."""
    return bins.groupBy("feature").agg(F.count("*").alias("bins"), F.sum("iv").alias("iv"))


def woe_transform(df: DataFrame, binning: Binning, features: Sequence[str] | None = None,
                  output: str = "suffix", missing: str = "zero") -> DataFrame:
    """Add <name>_WOE per feature, or replace the features under their names.

    missing='zero' gives missing values WoE 0, missing='woe' the WoE of the
    missing bin. Unseen categories get 0; numeric bins are open at both ends.
    """
    if output not in ("suffix", "replace") or missing not in ("zero", "woe"):
        raise ValueError(f"output={output!r}, missing={missing!r}")
    known = [*binning.numeric, *binning.categorical]
    features = list(features) if features is not None else [c for c in df.columns if c in known]
    unknown = [c for c in features if c not in known]
    if unknown:
        raise ValueError(f"features without bins: {unknown}")
    columns = df.columns
    numeric = [c for c in features if c in binning.numeric]
    result, lookup = _numeric_woe(df, {c: binning.numeric[c] for c in numeric}, missing)
    categorical = [c for c in features if c not in binning.numeric]
    result, more = _category_woe(result, binning.table, categorical, missing)
    lookup.update(more)
    if output == "replace":
        return result.select(*[lookup[c].alias(c) if c in lookup else col(c) for c in columns])
    return result.select(*[col(c) for c in columns], *[lookup[c].alias(f"{c}_WOE") for c in features])


def _numeric_woe(df: DataFrame, bins: dict[str, NumericBins], missing: str) -> tuple[DataFrame, dict[str, Column]]:
    if not bins:
        return df, {}
    absent = {c: b.missing if missing == "woe" else 0.0 for c, b in bins.items()}
    if len(bins) >= ARROW_FEATURES:
        return _numeric_woe_arrow(df, bins, absent)
    # Bucketizer cells are [a, b): the next double after an edge makes them (a, b].
    names = list(bins)
    cells = {c: [-math.inf, *[math.nextafter(e, math.inf) for e in bins[c].edges], math.inf] for c in names}
    binned = [c for c in names if bins[c].edges]
    for i, c in enumerate(names):
        df = df.withColumn(f"__x{i}", as_number(df, c))
    if binned:
        at = [names.index(c) for c in binned]
        df = Bucketizer(
            inputCols=[f"__x{i}" for i in at], outputCols=[f"__b{i}" for i in at],
            splitsArray=[cells[c] for c in binned], handleInvalid="keep",
        ).transform(df)
    lookup = {}
    for i, c in enumerate(names):
        if bins[c].edges:
            weights = F.array(*[F.lit(float(w)) for w in bins[c].woe])
            value = F.element_at(weights, (col(f"__b{i}") + 1).cast("int"))
        else:
            value = F.lit(float(bins[c].woe[0] if bins[c].woe else 0.0))
        lookup[c] = F.when(col(f"__x{i}").isNull(), F.lit(float(absent[c]))).otherwise(value)
    return df, lookup


def _numeric_woe_arrow(df: DataFrame, bins: dict[str, NumericBins], absent: dict[str, float]) -> tuple[DataFrame, dict[str, Column]]:
    names = list(bins)
    cuts = [np.array(bins[c].edges, dtype="float64") for c in names]
    weights = [np.array([*(bins[c].woe or (0.0,)), absent[c]], dtype="float64") for c in names]

    def look_up(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = {}
            for f, series in enumerate(batch):
                x = series.to_numpy(dtype="float64")
                values[f"w{f}"] = weights[f][np.where(np.isnan(x), -1, np.searchsorted(cuts[f], x, "left"))]
            yield pd.DataFrame(values)

    look_up.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    apply = F.pandas_udf(look_up, ", ".join(f"w{f} double" for f in range(len(names))))
    df = df.withColumn("__woe", apply(*[as_number(df, c) for c in names]))
    return df, {c: col("__woe")[f"w{f}"] for f, c in enumerate(names)}


def _category_woe(df: DataFrame, table: DataFrame, features: Sequence[str], missing: str) -> tuple[DataFrame, dict[str, Column]]:
    if not features:
        return df, {}
    bins = table.where(col("kind") == "categorical").select("feature", "category", "n", F.coalesce("woe", F.lit(0.0)).alias("woe"))
    sizes = {r.feature: r.n for r in bins.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    small = [c for c in features if sizes.get(c, 0) <= MAP_CATEGORIES]
    rows = bins.where(col("feature").isin(small)).collect() if small else []
    lookup = {}
    for i, c in enumerate(features):
        if c in small:
            known = {r.category: r.woe for r in rows if r.feature == c}
            absent = known.pop(None, 0.0) if missing == "woe" else (known.pop(None, 0.0) * 0.0)
            text = col(c).cast("string")
            value = F.lit(0.0)
            if known:
                pairs = F.create_map(*[F.lit(v) for pair in sorted(known.items()) for v in pair])
                value = F.coalesce(F.try_element_at(pairs, text), F.lit(0.0))
            lookup[c] = F.when(text.isNull(), F.lit(float(absent))).otherwise(value)
        else:
            mine = bins.where((col("feature") == c) & col("category").isNotNull()).select(
                col("category").alias(f"__c{i}"), col("woe").alias(f"__w{i}")
            )
            # Rows per category are those of the table to be scored, nulls and unseen values included.
            df = attach(df.withColumn(f"__c{i}", col(c).cast("string")), mine, [f"__c{i}"])
            absent = 0.0
            if missing == "woe":
                row = bins.where((col("feature") == c) & col("category").isNull()).select("woe").first()
                absent = row.woe if row else 0.0
            lookup[c] = F.when(col(c).isNull(), F.lit(float(absent))).otherwise(F.coalesce(col(f"__w{i}"), F.lit(0.0)))
    return df, lookup
