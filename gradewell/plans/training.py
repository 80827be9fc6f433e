"""The training runs: cross-validated or fixed-part logistic scorecards, and the
passive-aggressive scorecard with random search and calibration.

Every supervised step is fitted on training rows only, inside each fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import Roles, classify_columns, drop_null_target, positive_label, select_label
from gradewell.ml import GiniEvaluator, MrmrSelector, WoeEstimator, WoeModel
from gradewell.operators.binning import woe_transform
from gradewell.operators.calibrate import isotonic_fit
from gradewell.operators.linear import LinearScore
from gradewell.operators.metrics import gini
from gradewell.operators.online import pa_fit, pa_fit_many
from gradewell.operators.search import cross_validate, log_uniform, oof_predict, param_grid_search, random_search
from gradewell.operators.select import kept_features, low_corr_filter, mrmr_select, smart_correlated, top_corr_select
from gradewell.operators.split import fold_hash, kfold_assign, split_exact, split_hash
from gradewell.operators.stats import correlation_sets
from gradewell.sources.report import run_report
from gradewell.workspace import staged


@dataclass(frozen=True)
class Scorecard:
    """A fitted run: the model, the features it reads, its metrics, the search
    table and the settings of the run."""

    model: PipelineModel
    features: list[str]
    metrics: dict[str, float]
    search: DataFrame
    params: dict[str, object]

    def report(self, run_id: str) -> DataFrame:
        """The run as rows of the report table: metrics, settings, chosen features."""
        chosen = {f"feature_{i}": c for i, c in enumerate(self.features, 1)}
        return run_report(self.search.sparkSession, run_id, metrics=self.metrics, params=self.params | chosen)


def _prepared(df: DataFrame, roles: Roles, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    features = roles.features(df)
    others = [c for c in dict.fromkeys([*key, *roles.strata]) if c not in features and c != roles.target]
    table = positive_label(drop_null_target(df, roles.target), roles.target)
    return select_label(table, [*others, *features], "label"), features


def _folded(table: DataFrame, key: Sequence[str], folds: int, seed: object, exact: bool) -> DataFrame:
    """The table with its folds, by key hash or of equal size within each class, written fold by fold."""
    assigned = kfold_assign(table, "label", folds, seed, key) if exact else fold_hash(table, key, folds, seed)
    return staged(assigned, "folds", by="fold")


def _stages(features: Sequence[str], num_features: int, bins: int, trend: str) -> tuple[Pipeline, LogisticRegression]:
    woe = WoeEstimator(inputCols=list(features), labelCol="label", bins=bins, trend=trend)
    mrmr = MrmrSelector(inputCols=woe.woe_columns(), numFeatures=num_features, labelCol="label")
    regression = LogisticRegression(featuresCol="features", labelCol="label")
    return Pipeline(stages=[woe, mrmr, regression]), regression


def _grid(regression: LogisticRegression, tuning: bool) -> list[dict]:
    builder = ParamGridBuilder()
    if tuning:
        builder = builder.addGrid(regression.regParam, [0.01, 0.1]).addGrid(regression.elasticNetParam, [0.5])
    return builder.build()


def train_cross_validated(df: DataFrame, roles: Roles, key: Sequence[str], num_features: int = 30, folds: int = 3,
                          tuning: bool = False, seed: object = 34, bins: int = 20, trend: str = "auto",
                          exact_folds: bool = False) -> Scorecard:
    """WoE, mRMR and logistic regression under k-fold cross-validation. exact_folds
    makes folds of equal size within each class instead of by hash alone."""
    table, features = _prepared(df, roles, key)
    table = _folded(table, key, folds, seed, exact_folds)
    chain, regression = _stages(features, num_features, bins, trend)
    judge = GiniEvaluator()
    model, score, search = cross_validate(table, chain, _grid(regression, tuning), judge, "fold", folds)
    metrics = {"gini": score, "train_gini": judge.evaluate(model.transform(table))}
    params = {"run": "cross_validated", "folds": folds, "exact_folds": exact_folds, "seed": seed, "bins": bins, "trend": trend, "tuning": tuning}
    return Scorecard(model, model.stages[-2].getInputCols(), metrics, search, params)


def train_validated(df: DataFrame, roles: Roles, key: Sequence[str], num_features: int = 30, val_size: float = 0.05,
                    tuning: bool = False, seed: object = 34, bins: int = 20, trend: str = "auto",
                    filter_correlation: bool = False, exact_split: bool = False) -> Scorecard:
    """The same chain scored on one held-out part. filter_correlation keeps only
    the top third of the numeric features by |correlation| before binning;
    exact_split holds out the wanted share of every stratum and class to the row."""
    table, features = _prepared(df, roles, key)
    names = ("train", "dev")
    if exact_split:
        strata = [*[c for c in roles.strata if c != roles.target], "label"]
        parts = split_exact(table, strata, 1.0 - val_size, seed, key, names=names)
    else:
        parts = split_hash(table, key, 1.0 - val_size, seed, names=names)
    parts = staged(parts, "parts", by="split")
    train, dev = parts.where("split = 'train'"), parts.where("split = 'dev'")
    if filter_correlation:
        numeric, categorical = classify_columns(table, features)
        top = low_corr_filter(train, numeric, "label").orderBy("rank").collect()
        features = [r["feature"] for r in top] + categorical
    chain, regression = _stages(features, num_features, bins, trend)
    judge = GiniEvaluator()
    best, score, search = param_grid_search(train, dev, chain, _grid(regression, tuning), judge)
    metrics = {"gini": score, "train_gini": judge.evaluate(best.transform(train))}
    params = {
        "run": "validated", "val_size": val_size, "exact_split": exact_split, "seed": seed, "bins": bins, "trend": trend, "tuning": tuning,
        "filter_correlation": filter_correlation,
    }
    return Scorecard(best, best.stages[-2].getInputCols(), metrics, search, params)


def _binner(features: Sequence[str], bins: int) -> WoeEstimator:
    return WoeEstimator(inputCols=list(features), labelCol="label", bins=bins, trend="auto_asc_desc")


def _select_and_bin(train: DataFrame, features: Sequence[str], num_features: int, top_share: float, bins: int,
                    binned: WoeModel | None = None, known: DataFrame | None = None) -> tuple[WoeModel, list[str]]:
    """Correlated groups out, top share by correlation, WoE bins, mRMR: the fitted
    binning and the selected WoE columns. `binned` has the bins of all features and
    `known` their correlations with the label already."""
    numeric, categorical = classify_columns(train, features)
    kept = kept_features(smart_correlated(train, numeric)) if numeric else []
    top = top_corr_select(train, kept + categorical, "label", top_share, known).orderBy("rank").collect()
    names = [r["feature"] for r in top]
    if binned is None:
        woe = _binner(names, bins).fit(train)
    else:
        woe = WoeModel(inputCols=names)
        woe.binning = binned.binning
    chosen = mrmr_select(woe.transform(train), woe.woe_columns(), "label", num_features).orderBy("rank").collect()
    return woe, [r["feature"] for r in chosen]


def _scores_of(woe: WoeModel, models: Sequence[LinearScore]):
    """The function that gives rows the label and the score of every model."""
    def score(rows: DataFrame) -> DataFrame:
        values = woe.transform(rows)
        return values.select("label", *[(1.0 / (1.0 + F.exp(-m.decision()))).alias(f"score_{i}") for i, m in enumerate(models)])

    return score


def train_passive_aggressive(df: DataFrame, roles: Roles, key: Sequence[str], num_features: int = 30, trials: int = 20,
                             folds: int = 3, seed: int = 42, cost_range: tuple[float, float] = (10.0, 20.0),
                             top_share: float = 0.5, bins: int = 20, partitions: int | None = None, max_iter: int = 10,
                             exact_folds: bool = False) -> Scorecard:
    """Random search over C by out-of-fold Gini, then a calibrated final model.

    Within a fold, selection and binning do not depend on C: they are fitted
    once and all candidates are trained in the same passes over the rows.
    """
    table, features = _prepared(df, roles, key)
    table = _folded(table, key, folds, seed, exact_folds)
    options = {"partitions": partitions, "max_iter": max_iter, "seed": seed}

    def fit_folds(rows: DataFrame, costs: Sequence[float]):
        # Bins and correlations of all features and folds come from the same scans; what is selected may differ from fold to fold.
        binned = _binner(features, bins).fit_folds(rows, "fold", folds)
        numeric, _ = classify_columns(rows, features)
        known = correlation_sets(rows, numeric, "label", "fold", folds) if numeric else [None] * folds
        scorers = []
        for i in range(folds):
            train = rows.where(F.col("fold") != i)
            woe, chosen = _select_and_bin(train, features, num_features, top_share, bins, binned[i], known[i])
            models = pa_fit_many(woe.transform(train), chosen, "label", key, costs, **options)
            scorers.append(_scores_of(woe, models))
        return scorers

    costs = log_uniform(trials, *cost_range, seed)
    best, search = random_search(table, "label", "fold", folds, costs, fit_folds=fit_folds)

    woe, chosen = _select_and_bin(table, features, num_features, top_share, bins)
    inputs = [c.removesuffix("_WOE") for c in chosen]
    ready = staged(woe_transform(table, woe.binning, inputs).select(*key, "fold", *chosen, "label"), "woe", by="fold")

    def refit(train: DataFrame):
        return pa_fit(train, chosen, "label", key, best, **options).transform

    # The calibration is learnt on scores of rows the scoring model has not seen.
    oof = oof_predict(ready, "fold", folds, refit).select("score", "label")
    calibration = isotonic_fit(oof, "score", "label")
    final = pa_fit(ready, chosen, "label", key, best, **options)
    woe_inputs = WoeModel(inputCols=inputs)
    woe_inputs.binning = woe.binning
    model = PipelineModel([woe_inputs, final, calibration])
    train_gini = gini(calibration.transform(final.transform(ready)), "calibrated", "label")
    oof_gini = search.where("best").first()["gini"]
    params = {"run": "passive_aggressive", "C": best, "trials": trials, "folds": folds, "exact_folds": exact_folds, "seed": seed, "bins": bins}
    return Scorecard(model, chosen, {"gini": oof_gini, "train_gini": train_gini, "C": best}, search, params)
