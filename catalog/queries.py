"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import (
    CATEGORICAL, FEATURES, KEY, NOT_FEATURES, NUMERIC, TARGET, WIDE, labelled, modelling_table, scored_lines, table,
)
from gradewell import Roles
from gradewell.columns import (
    drop_null_target, feature_columns, nullable_schema, positive_label, select_label,
)
from gradewell.ml import GiniEvaluator, WoeEstimator
from gradewell.operators import calibrate, checks, metrics, select, split, stats
from gradewell.operators.binning import Binning, fit_binning, fit_binnings, iv_table, woe_transform
from gradewell.operators.linear import LinearScore, assemble, logistic_fit, logistic_score
from gradewell.operators.online import pa_fit
from gradewell.operators.quantiles import woe_prebin
from gradewell.operators.search import adaptive_random_search, log_uniform, oof_score, param_grid_search, random_search
from gradewell.operators.state import BinState
from gradewell.plans.jobs import score_frame, split_job
from gradewell.plans.training import train_validated
from gradewell.sources import append_report, chunked_export, parquet_scan, parquet_sink
from gradewell.sources.report import metric_rows, run_report
from gradewell.workspace import scratch_path, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PREBINS = 10
STRATA = ["yr", TARGET]
LINEAR = ["l_quantity", "l_discount", "l_extendedprice"]
EXPORT_ROWS = 10_000
GRID_BINS = [2, 5, 20]
DRAWN = [float(int(c)) for c in log_uniform(4, 2.0, 30.0, 42)]
ROLES = Roles(TARGET, STRATA, NOT_FEATURES)


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


# --- sources, sinks and checks ---------------------------------------------

@query("parquet_scan")
def parquet_read(spark: SparkSession, folder: str) -> DataFrame:
    orders = parquet_scan(spark, f"{folder}/orders.parquet")
    return orders.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("parquet_sink")
def parquet_sink_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "sink")
    parquet_sink(table(spark, folder, "orders"), path, partition_by="o_orderstatus")
    return parquet_scan(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("chunked_export")
def chunked_export_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every row comes back, and no file holds more rows than the limit."""
    path = scratch_path(spark, "export")
    source = table(spark, folder, "lineitem")
    chunked_export(source, path, rows=EXPORT_ROWS)
    batches = parquet_scan(spark, path, nullable_schema(source))
    per_file = batches.withColumn("file", F.input_file_name()).groupBy("file").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_quantity").alias("quantity")
    )
    return per_file.agg(
        F.sum("n").alias("n_rows"), F.sum("keys").alias("keys"), F.round(F.sum("quantity"), 2).alias("quantity"),
        (F.max("n") <= EXPORT_ROWS).alias("within_limit"), (F.count("*") * EXPORT_ROWS >= F.sum("n")).alias("enough_files"),
    )


@query("run_report")
def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "report")
    for name in ("orders", "lineitem"):
        append_report(metric_rows(checks.row_shape(table(spark, folder, name)), name, ["n_rows", "n_columns"]), path)
    counts = {r[TARGET]: r["n"] for r in checks.class_distribution(labelled(spark, folder), TARGET).collect()}
    append_report(run_report(
        spark, "labels", metrics={"events": counts[1], "non_events": counts[0]}, params={"target": TARGET, "folds": 3},
        messages=[{"level": "INFO", "message": f"{sum(counts.values())} rows", "logger": "catalog", "function": "report_rows", "line": 7}],
    ), path)
    return spark.read.parquet(path)


@query("column_types")
def column_types(spark: SparkSession, folder: str) -> DataFrame:
    return checks.column_types(scored_lines(spark, folder)).select(
        "name", "data_type", "nullable", F.col("max_len").cast("bigint").alias("max_len")
    )


@query("not_null_check")
def not_null_check(spark: SparkSession, folder: str) -> DataFrame:
    return checks.not_null_check(scored_lines(spark, folder), ["l_orderkey", "l_tax", "c_acctbal", TARGET])


@query("unique_key_check")
def unique_key_check(spark: SparkSession, folder: str) -> DataFrame:
    return checks.unique_key_check(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("class_distribution")
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return checks.class_distribution(scored_lines(spark, folder), TARGET, ["yr"])


@query("row_shape")
def row_shape(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_lines(spark, folder).select(*KEY, "l_quantity", "l_tax", TARGET)
    return split_job(rows, Roles(TARGET), scratch_path(spark, "split"), 0.9, 34, KEY)


@query("constant_filter")
def constant_filter(spark: SparkSession, folder: str) -> DataFrame:
    return checks.constant_filter(scored_lines(spark, folder), NUMERIC)


# --- projections and filters -----------------------------------------------

@query("feature_columns")
def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    return feature_columns(scored_lines(spark, folder), NOT_FEATURES, TARGET).select(
        *rounded("l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal", "price2", "const_f"), *CATEGORICAL
    )


@query("drop_null_target")
def drop_null_target_rows(spark: SparkSession, folder: str) -> DataFrame:
    return drop_null_target(scored_lines(spark, folder), TARGET).select(*KEY, TARGET)


@query("select_label")
def select_label_columns(spark: SparkSession, folder: str) -> DataFrame:
    return select_label(scored_lines(spark, folder), ["l_quantity", "l_linestatus"], TARGET)


@query("strata_key")
def strata_key(spark: SparkSession, folder: str) -> DataFrame:
    return split.strata_key(scored_lines(spark, folder), STRATA)


@query("strata_distinct")
def strata_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return split.strata_distinct(scored_lines(spark, folder), STRATA)


# --- statistics and selection ----------------------------------------------

@query("label_correlation")
def label_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_correlation(scored_lines(spark, folder), NUMERIC, TARGET).select("feature", "n", *rounded("corr", "abs_corr"))


@query("pairwise_correlation")
def pairwise_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return stats.pairwise_correlation(modelling_table(spark, folder, NUMERIC), NUMERIC).select(
        "feature_a", "feature_b", "n", *rounded("corr")
    )


@query("f_statistic")
def f_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return stats.f_statistic(scored_lines(spark, folder), NUMERIC, TARGET).select("feature", "n", *rounded("f"))


@query("low_corr_filter")
def low_corr_filter(spark: SparkSession, folder: str) -> DataFrame:
    return select.low_corr_filter(scored_lines(spark, folder), NUMERIC, TARGET).select("rank", "feature", *rounded("abs_corr"))


@query("top_corr_select")
def top_corr_select(spark: SparkSession, folder: str) -> DataFrame:
    return select.top_corr_select(scored_lines(spark, folder), FEATURES, TARGET, 0.5).select(
        "rank", "feature", "kind", *rounded("abs_corr")
    )


@query("mrmr_select")
def mrmr_select(spark: SparkSession, folder: str) -> DataFrame:
    rows = modelling_table(spark, folder, [*NUMERIC, TARGET])
    return select.mrmr_select(rows, NUMERIC, TARGET, 3).select("rank", "feature", F.round("score", 3).alias("score"))


@query("drop_correlated")
def drop_correlated(spark: SparkSession, folder: str) -> DataFrame:
    return select.drop_correlated(modelling_table(spark, folder, NUMERIC), NUMERIC)


@query("smart_correlated")
def smart_correlated(spark: SparkSession, folder: str) -> DataFrame:
    return select.smart_correlated(modelling_table(spark, folder, NUMERIC), NUMERIC)


@query("single_feature_gini")
def single_feature_gini(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.single_feature_gini(scored_lines(spark, folder), NUMERIC, TARGET).select(
        "feature", "n", *rounded("auc", "gini", "ks")
    )


# --- splits and folds --------------------------------------------------------

@query("split_hash")
def split_hash(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_hash(scored_lines(spark, folder), KEY, 0.9, "split").select(*KEY, "split")


@query("split_exact")
def split_exact(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_exact(labelled(spark, folder).select(*KEY, *STRATA), STRATA, 0.9, "split", KEY).select(*KEY, "split")


@query("split_except_all")
def split_except_all(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    part = table(spark, folder, "lineitem").where("l_shipdate < timestamp_ntz '1996-01-01 00:00:00'").select(*rows.columns)
    return split.split_except_all(rows, part)


@query("train_val_split")
def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.train_val_split(scored_lines(spark, folder), KEY, 0.05, 34).select(*KEY, "is_val")


@query("kfold_assign")
def kfold_assign(spark: SparkSession, folder: str) -> DataFrame:
    return split.kfold_assign(labelled(spark, folder).select(*KEY, TARGET), TARGET, 3, "fold", KEY)


@query("fold_hash")
def fold_hash(spark: SparkSession, folder: str) -> DataFrame:
    return split.fold_hash(labelled(spark, folder).select(*KEY), KEY, 3, "fold")


# --- binning -------------------------------------------------------------------

@query("label_index")
def label_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_lines(spark, folder).select("o_orderpriority")
    indexed = StringIndexer(inputCol="o_orderpriority", outputCol="index").fit(rows).transform(rows)
    chosen = positive_label(indexed, "o_orderpriority", "1-URGENT")
    return chosen.groupBy("o_orderpriority", "index", "label").agg(F.count("*").alias("n"))


def binned(spark: SparkSession, folder: str, features: Sequence[str] = FEATURES, **options) -> Binning:
    rows = modelling_table(spark, folder, [*features, TARGET])
    return fit_binning(rows, features, TARGET, **options)


@query("woe_prebin")
def woe_prebins(spark: SparkSession, folder: str) -> DataFrame:
    numeric = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal"]
    return woe_prebin(modelling_table(spark, folder, numeric), numeric, 20).select("feature", "edge_no", *rounded("edge"))


@query("woe_bins")
def woe_bins(spark: SparkSession, folder: str) -> DataFrame:
    return binned(spark, folder).table.select(
        "feature", "bin", "category", "is_missing", "n", "events", "non_events", *rounded("event_rate", "woe", "iv")
    )


@query("iv_table")
def iv_per_feature(spark: SparkSession, folder: str) -> DataFrame:
    return iv_table(binned(spark, folder).table).select("feature", "bins", *rounded("iv"))


@query("woe_monotone")
def woe_monotone(spark: SparkSession, folder: str) -> DataFrame:
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    bins = binned(spark, folder, features, bins=PREBINS, trend="auto_asc_desc").table
    return bins.select("feature", "bin", "n", "events", *rounded("woe", "iv"))


@query("woe_transform")
def woe_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = modelling_table(spark, folder, [*KEY, *FEATURES, TARGET], all_rows=True)
    fitted = fit_binning(rows, FEATURES, TARGET)
    return woe_transform(rows, fitted, FEATURES, missing="woe").select(*KEY, *rounded(*[f"{c}_WOE" for c in FEATURES]))


@query("woe_replace")
def woe_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = modelling_table(spark, folder, [*KEY, "l_tax", "l_linestatus", TARGET], all_rows=True)
    fitted = fit_binning(rows, ["l_tax", "l_linestatus"], TARGET)
    return woe_transform(rows, fitted, output="replace").select(*KEY, *rounded("l_tax", "l_linestatus"))


# --- metrics -------------------------------------------------------------------

def by_rule(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select(
        TARGET, (F.col("l_quantity") / 50.0).alias("p"), (F.col("l_quantity") > 40).cast("int").alias("prediction")
    )


@query("auc_gini")
def auc_gini(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.auc_gini(labelled(spark, folder), "l_extendedprice", TARGET).select("n", "events", *rounded("auc", "gini"))


@query("ks_statistic")
def ks_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ks_statistic(labelled(spark, folder), "l_quantity", TARGET).select("n", *rounded("ks"))


@query("gini_hard")
def gini_hard(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.gini_hard(by_rule(spark, folder), "prediction", TARGET).select(*rounded("gini"))


@query("calibration_curve")
def calibration_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.calibration_curve(by_rule(spark, folder), "p", TARGET).select("bin", "n", *rounded("mean_prob", "event_rate"))


@query("confusion_metrics")
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_metrics(by_rule(spark, folder), "prediction", TARGET).select(
        "tp", "fp", "tn", "fn", *rounded("accuracy", "precision", "recall", "f1", "roc_auc")
    )


# --- models ----------------------------------------------------------------------

@query("assemble")
def assembled(spark: SparkSession, folder: str) -> DataFrame:
    vectors = assemble(labelled(spark, folder), LINEAR)
    parts = vector_to_array("features")
    return vectors.select(*KEY, *[F.round(parts[i], 6).alias(f"f{i}") for i in range(len(LINEAR))])


@query("pa_proba")
def pa_proba(spark: SparkSession, folder: str) -> DataFrame:
    score = LinearScore(inputCols=["l_quantity", "l_discount"], weights=[0.08, 10.0], bias=-5.0)
    return score.transform(labelled(spark, folder)).select(*KEY, *rounded("score"), F.col("prediction").cast("int").alias("prediction"))


@query("oof_predict")
def oof_predict_woe(spark: SparkSession, folder: str) -> DataFrame:
    rows = split.fold_hash(labelled(spark, folder).select(*KEY, "l_linestatus", "o_orderpriority", TARGET), KEY, 3, "fold")
    rows = staged(rows, "folds")

    fitted = fit_binnings(rows, ["l_linestatus", "o_orderpriority"], TARGET, [{}], "fold", 3)
    scored = oof_score(rows, "fold", [lambda part, one=one: woe_transform(part, one[0]) for one in fitted])
    return scored.select(*KEY, "fold", F.round(F.col("l_linestatus_WOE") + F.col("o_orderpriority_WOE"), 6).alias("score"))


@query("isotonic_calibrate")
def isotonic_calibrate(spark: SparkSession, folder: str) -> DataFrame:
    rows = modelling_table(spark, folder, ["l_quantity", TARGET])
    return calibrate.isotonic_calibrate(rows, "l_quantity", TARGET).groupBy("l_quantity").agg(
        F.count("*").alias("n"), F.round(F.max("calibrated"), 6).alias("calibrated")
    )


@query("logistic_fit")
def logistic_moments(spark: SparkSession, folder: str) -> DataFrame:
    """The likelihood is largest exactly where, for the intercept and every
    feature, predicted probabilities and events have the same mean (to the
    eight digits the optimiser reaches)."""
    rows = modelling_table(spark, folder, [*LINEAR, TARGET])
    scored = logistic_score(logistic_fit(rows, LINEAR, TARGET, tol=1e-12, max_iter=500), rows)
    terms = F.array(*[
        F.struct(F.lit(n).alias("term"), v.cast("double").alias("x")) for n, v in [("intercept", F.lit(1)), *[(c, F.col(c)) for c in LINEAR]]
    ])
    return scored.select("score", F.inline(terms)).groupBy("term").agg(F.round(F.avg(F.col("score") * F.col("x")), 2).alias("moment"))


def fitted_score() -> Column:
    """To the digits that the optimiser surely reaches, whatever the layout of the rows."""
    return F.round("score", 4).alias("score")


def by_status(spark: SparkSession, folder: str) -> DataFrame:
    """One yes/no feature: a fitted model must give each side its event rate."""
    return modelling_table(spark, folder, [*KEY, "l_linestatus", TARGET]).withColumn(
        "is_f", (F.col("l_linestatus") == "F").cast("double")
    )


@query("logistic_score")
def logistic_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = by_status(spark, folder)
    model = logistic_fit(rows, ["is_f"], TARGET, tol=1e-12, max_iter=500)
    return logistic_score(model, rows).select(*KEY, fitted_score())


@query("model_save_load")
def reloaded_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = by_status(spark, folder)
    path = scratch_path(spark, "model")
    logistic_fit(rows, ["is_f"], TARGET, tol=1e-12, max_iter=500).write().overwrite().save(path)
    return score_frame(PipelineModel.load(path), rows).select(*KEY, fitted_score())


@query("param_grid_search")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """How many bins does the feature deserve? Each point bins on the training part
    and is scored by the Gini of its WoE on the other (negative: WoE falls with risk)."""
    rows = modelling_table(spark, folder, [*KEY, "l_quantity", TARGET])
    parts = split.train_val_split(rows, KEY, 0.2, 34)
    woe = WoeEstimator(inputCols=["l_quantity"], labelCol=TARGET, trend="none")
    grid = ParamGridBuilder().addGrid(woe.bins, GRID_BINS).build()
    judge = GiniEvaluator(scoreCol="l_quantity_WOE", labelCol=TARGET)
    table = param_grid_search(parts.where("not is_val"), parts.where("is_val"), woe, grid, judge)[2]
    return table.select("point", "params", *rounded("score"), "best")


def quantity_folds(rows: DataFrame, costs: Sequence[float]) -> list[Callable[[DataFrame], DataFrame]]:
    """Per fold the function that adds the WoE of the quantity from as many bins as each cost says."""
    fitted = fit_binnings(rows, ["l_quantity"], TARGET, [{"bins": int(c)} for c in costs], "fold", 3)

    def scorer(binnings: list[Binning]) -> Callable[[DataFrame], DataFrame]:
        def score(part: DataFrame) -> DataFrame:
            for i, binning in enumerate(binnings):
                part = woe_transform(part, binning).withColumnRenamed("l_quantity_WOE", f"score_{i}")
            return part

        return score

    return [scorer(binnings) for binnings in fitted]


@query("random_search")
def random_search_cost(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn numbers are taken as numbers of bins; the score of a candidate is
    the WoE that each fold's rows get from bins of the other folds."""
    rows = split.fold_hash(labelled(spark, folder).select(*KEY, "l_quantity", TARGET), KEY, 3, 42).drop(*KEY)
    rows = staged(rows, "folds", by="fold")  # so that a fold is scored without reading the others
    table = random_search(rows, TARGET, "fold", 3, DRAWN, fit_folds=quantity_folds)[1]
    return table.select(F.col("cost").cast("int").alias("bins"), *rounded("gini"), "best")


@query("pa_fit")
def pa_fit_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed by the feature itself, complete copies collapse to at most a hundred
    (value, label) groups, which SQL can run through one by one."""
    rows = modelling_table(spark, folder, [*KEY, "l_quantity", TARGET])
    model = pa_fit(rows, ["l_quantity"], TARGET, ["l_quantity"], cost=15.0, max_iter=2, partitions=1)
    return model.transform(rows).select(*KEY, *rounded("score"), F.col("prediction").cast("int").alias("prediction"))


@query("score_frame")
def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted model over a table that carries the scores of earlier ones."""
    rows = by_status(spark, folder)
    model = logistic_fit(rows, ["is_f"], TARGET, tol=1e-12, max_iter=500)
    crowded = rows.withColumns({"score": F.lit(0.9), "calibrated": F.lit(0.8), "prediction": F.lit("A"), "probability": F.lit(0.7)})
    return score_frame(model, crowded).select(
        *KEY, fitted_score(), F.col("prediction").cast("int").alias("prediction"), "calibrated", "probability"
    )


@query("final_scorecard")
def final_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """The features of a trained scorecard: the order they were chosen in, their
    information value, and the mean of score x WoE over the training rows, which
    in a fitted regression equals that of label x WoE."""
    rows = modelling_table(spark, folder, all_rows=True)
    card = train_validated(
        rows, ROLES, KEY, num_features=3, val_size=0.2, bins=PREBINS, trend="auto_asc_desc", filter_correlation=True
    )
    train = split.split_hash(rows.where(f"{TARGET} is not null"), KEY, 0.8, 34, names=("train", "dev")).where("split = 'train'")
    scored = card.model.transform(train).withColumn("__p", vector_to_array("probability")[1])
    terms = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(c.removesuffix("_WOE")).alias("feature"), F.col(c).alias("woe")) for i, c in enumerate(card.features, 1)
    ])
    moments = scored.select("__p", F.inline(terms)).groupBy("rank", "feature").agg(F.round(F.avg(F.col("__p") * F.col("woe")), 3).alias("moment"))
    return moments.join(iv_table(card.model.stages[0].binning.table), "feature").select("rank", "feature", "bins", *rounded("iv"), "moment")


@query("woe_many_features")
def woe_many_features(spark: SparkSession, folder: str) -> DataFrame:
    """As many numeric features as training runs have: the look-up in Arrow batches."""
    rows = modelling_table(spark, folder, [*KEY, *WIDE, TARGET], all_rows=True, wide=True)
    return woe_transform(rows, fit_binning(rows, list(WIDE), TARGET, bins=5), list(WIDE)).select(*KEY, *rounded(*[f"{c}_WOE" for c in WIDE]))


@query("woe_large_domain")
def woe_large_domain(spark: SparkSession, folder: str) -> DataFrame:
    """More categories than are broadcast: orders as categories of their lines."""
    rows = labelled(spark, folder).select(*KEY, F.col("l_orderkey").cast("string").alias("order_name"), TARGET)
    rows = staged(rows, "orders")
    train = rows.where("l_linenumber <= 3")  # some orders are unseen
    return woe_transform(rows, fit_binning(train, ["order_name"], TARGET), ["order_name"]).select(*KEY, *rounded("order_name_WOE"))


# Category names of a share of the rows near this one: about half of them are pooled.
MIXED_SHARE, MIXED_BINS = 0.04, 3


@query("woe_category_groups")
def woe_category_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Rare categories pooled, the others merged by event rate into three bins at most."""
    mixed = F.concat_ws("/", "o_orderpriority", "c_mktsegment").alias("mixed")
    rows = labelled(spark, folder).select(mixed, TARGET)
    fitted = fit_binning(rows, ["mixed"], TARGET, category_share=MIXED_SHARE, max_bins=MIXED_BINS)
    return fitted.table.select("category", "bin", "n", "events", *rounded("woe", "iv"))


@query("woe_incremental")
def woe_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Bins from stored counts to which every year is added without reading earlier ones."""
    features = ["l_quantity", "l_discount", "l_tax", "o_orderpriority"]
    rows, path = modelling_table(spark, folder, [*features, "yr", TARGET]), scratch_path(spark, "bin-state")
    years = [r["yr"] for r in rows.select("yr").distinct().orderBy("yr").collect()]
    for i, year in enumerate(years):
        BinState.of(rows.where(F.col("yr") == year), features, TARGET).save(path, append=i > 0)
    return BinState.load(spark, path).binning(bins=PREBINS).table.select(
        "feature", "bin", "category", "n", "events", *rounded("woe", "iv")
    )


@query("adaptive_search")
def adaptive_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of bins proposed batch by batch from the out-of-fold Gini of earlier ones."""
    rows = split.fold_hash(labelled(spark, folder).select(*KEY, "l_quantity", TARGET), KEY, 3, 42).drop(*KEY)
    rows = staged(rows, "folds", by="fold")  # so that a fold is scored without reading the others
    table = adaptive_random_search(rows, TARGET, "fold", 3, 6, 2.0, 30.0, 42, batch=3, fit_folds=quantity_folds)[1]
    return table.select(F.col("cost").cast("int").alias("bins"), *rounded("gini"), "batch", "best")
