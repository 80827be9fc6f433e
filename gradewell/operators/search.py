"""Model search: grids and random draws scored on folds or on a fixed part."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.functions.scores import logistic
from gradewell.operators.metrics import ginis
from gradewell.operators.newton import logistic_fits


def param_table(df: DataFrame, grid: Sequence[dict], scores: Sequence[float]) -> DataFrame:
    """(point, params, score, best): one row per grid point."""
    best = _best(scores)
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda e: e[0].name)), float(s), i == best)
        for i, (point, s) in enumerate(zip(grid, scores))
    ]
    return df.sparkSession.createDataFrame(rows, "point int, params string, score double, best boolean")


def _try_grid(train: DataFrame, dev: DataFrame, estimator: Estimator, grid: Sequence[dict], evaluator: Evaluator,
              parallelism: int) -> list[tuple[Callable[[], Model], float]]:
    """(what gives the model, score on dev) per grid point. Stages ahead of the first one that
    the grid touches are the same for all points and are fitted once; a single
    stage left fits all points by its fitMultiple, which may share scans, and logistic
    regressions take their steps together. An evaluator that can score several
    models does so in the same passes."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    touched = {p.parent for point in grid for p in point}
    first = next((i for i, s in enumerate(stages) if s.uid in touched), len(stages) - 1)
    shared = Pipeline(stages=stages[:first]).fit(train)
    train, dev = shared.transform(train), shared.transform(dev)
    needed = _read_by(stages[first:], grid, evaluator, train.columns)
    train, dev = (part.select(*[col(c) for c in needed]).persist() for part in (train, dev))
    try:
        if len(stages) - first == 1 and len(grid) > 1 and _joint(stages[first], grid, evaluator):
            scores = _joint_scores(stages[first], grid, train, dev, evaluator)
            return [(_later(shared, stages[first], point, train), score) for point, score in zip(grid, scores)]
        with ThreadPool(min(parallelism, len(grid))) as pool:
            def in_parallel(work: Callable, count: int) -> list:
                return pool.map(inheritable_thread_target(train.sparkSession)(work), range(count))

            if len(stages) - first == 1:
                models, fitted = [None] * len(grid), stages[first].fitMultiple(train, grid)

                def fit_next(_):
                    i, model = next(fitted)
                    models[i] = PipelineModel([*shared.stages, model])

                in_parallel(fit_next, len(grid))
            else:
                tail = Pipeline(stages=stages[first:])
                models = in_parallel(lambda i: PipelineModel([*shared.stages, *tail.fit(train, grid[i]).stages]), len(grid))
            tails = [PipelineModel(m.stages[first:]) for m in models]
            if hasattr(evaluator, "evaluate_models"):
                scores = evaluator.evaluate_models(tails, dev)
            else:
                scores = in_parallel(lambda i: evaluator.evaluate(tails[i].transform(dev)), len(grid))
        return [(lambda m=model: m, score) for model, score in zip(models, scores)]
    finally:
        train.unpersist()
        dev.unpersist()


def _read_by(stages: Sequence[Estimator], grid: Sequence[dict], evaluator: Evaluator, columns: Sequence[str]) -> list[str]:
    """The columns that are kept for the stages left: of logistic regressions judged by an exact Gini
    those that they name, so that a task does not hold all the others; of other stages all."""
    named = hasattr(evaluator, "columns_read") and all(type(s) is LogisticRegression for s in stages)
    if not named or any(p.name.endswith("Col") for point in grid for p in point):
        return list(columns)
    names = {s.getOrDefault(p) for s in stages for p in s.params if p.name.endswith("Col") and s.isDefined(p)}
    return [c for c in columns if c in names or c in evaluator.columns_read()]


def _later(shared: PipelineModel, stage: Estimator, point: dict, train: DataFrame) -> Callable[[], Model]:
    """Fits one point when it is asked for."""
    return lambda: PipelineModel([*shared.stages, stage.fit(train, point)])


def _joint(stage: Estimator, grid: Sequence[dict], evaluator: Evaluator) -> bool:
    """Whether the points are penalties of a plain logistic regression that an exact Gini of its probability compares."""
    if type(stage) is not LogisticRegression or not hasattr(evaluator, "compare") or evaluator.getOrDefault("scoreCol") != stage.getProbabilityCol():
        return False
    plain = stage.getFitIntercept() and stage.getStandardization() and not stage.isDefined("weightCol")
    bounded = any(stage.isSet(p) for p in stage.params if "Bounds" in p.name)
    return plain and not bounded and all(p in (stage.regParam, stage.elasticNetParam) for point in grid for p in point)


def _joint_scores(stage: LogisticRegression, grid: Sequence[dict], train: DataFrame, dev: DataFrame, evaluator: Evaluator) -> list[float]:
    features, label = vector_to_array(col(stage.getFeaturesCol())), stage.getLabelCol()
    width = train.select(F.size(features)).first()
    if width is None:
        return [math.nan] * len(grid)
    names = [f"f{i}" for i in range(width[0])]
    flat = [part.select(col(label).alias("label"), *[features[i].alias(c) for i, c in enumerate(names)]) for part in (train, dev)]
    points = [(point.get(stage.regParam, stage.getRegParam()), point.get(stage.elasticNetParam, stage.getElasticNetParam())) for point in grid]
    models = logistic_fits(flat[0], names, "label", points)[0]
    scored = flat[1].select("label", *[logistic(m.decision()).alias(f"score_{i}") for i, m in enumerate(models)])
    return evaluator.compare(scored, len(models))


def _best(scores: Sequence[float]) -> int:
    """The first of the largest; an undefined score loses to any other."""
    return max(range(len(scores)), key=lambda i: (-math.inf if math.isnan(scores[i]) else scores[i], -i))


def cross_validate(df: DataFrame, estimator: Estimator, grid: Sequence[dict], evaluator: Evaluator, fold_col: str,
                   folds: int, parallelism: int = 2) -> tuple[Model, float, DataFrame]:
    """(best model refitted on all rows, best mean score, score table). All
    stages are refitted inside every fold, so nothing is learnt from its rows. A
    first stage that the grid does not touch and that has fit_folds is fitted for
    all folds from the same scans."""
    scores, fitted = [0.0] * len(grid), None
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    if len(stages) > 1 and hasattr(stages[0], "fit_folds") and stages[0].uid not in {p.parent for point in grid for p in point}:
        fitted = stages[0].fit_folds(df, fold_col, folds)
    for i in range(folds):
        train, dev = df.where(col(fold_col) != i), df.where(col(fold_col) == i)
        chain = Pipeline(stages=[fitted[i], *stages[1:]]) if fitted else estimator
        for j, (_, score) in enumerate(_try_grid(train, dev, chain, grid, evaluator, parallelism)):
            scores[j] += score / folds
    best = _best(scores)
    return estimator.fit(df, grid[best]), scores[best], param_table(df, grid, scores)


def param_grid_search(train: DataFrame, dev: DataFrame, estimator: Estimator, grid: Sequence[dict],
                      evaluator: Evaluator, parallelism: int = 2) -> tuple[Model, float, DataFrame]:
    """(best model, best score, score table) by the score on a fixed part."""
    tried = _try_grid(train, dev, estimator, grid, evaluator, parallelism)
    scores = [s for _, s in tried]
    best = _best(scores)
    return tried[best][0](), scores[best], param_table(train, grid, scores)


def log_uniform(count: int, low: float, high: float, seed: int) -> list[float]:
    """Seeded draws with uniform logarithm."""
    source = random.Random(seed)
    return [math.exp(source.uniform(math.log(low), math.log(high))) for _ in range(count)]


def oof_score(df: DataFrame, fold_col: str, scorers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of every fold through the scorer of that fold."""
    return reduce(DataFrame.unionByName, [score(df.where(col(fold_col) == i)) for i, score in enumerate(scorers)])


def oof_predict(df: DataFrame, fold_col: str, folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every row scored by a model that was fitted without its fold. `fit` takes
    the training rows and returns the function that scores others. What can be
    fitted for all folds from the same scans, as bins can, goes to oof_score."""
    return oof_score(df, fold_col, [fit(df.where(col(fold_col) != i)) for i in range(folds)])


def random_search(df: DataFrame, label: str, fold_col: str, folds: int, costs: Sequence[float],
                  fit_many: Callable[[DataFrame, Sequence[float]], Callable[[DataFrame], DataFrame]] | None = None,
                  fit_folds: Callable[[DataFrame, Sequence[float]], Sequence[Callable[[DataFrame], DataFrame]]] | None = None) -> tuple[float, DataFrame]:
    """(best cost, (cost, gini, best) table) by the out-of-fold Gini.

    `fit_many` prepares a fold once and fits all candidates together; its
    result adds score_0, score_1, ... in the order of `costs`. `fit_folds` does so
    for all folds at once and returns one such function per fold.
    """
    names = [f"score_{i}" for i in range(len(costs))]
    if fit_folds:
        scored = oof_score(df, fold_col, fit_folds(df, costs))
    else:
        scored = oof_predict(df, fold_col, folds, lambda part: fit_many(part, costs))
    found = ginis(scored.select(label, *names), names, label)
    values = [found.get(n) if found.get(n) is not None else float("-inf") for n in names]
    best = _best(values)
    rows = [(float(c), float(g), i == best) for i, (c, g) in enumerate(zip(costs, values))]
    return float(costs[best]), df.sparkSession.createDataFrame(rows, "cost double, gini double, best boolean")


# Share of the finished trials that count as good, and the proposals that compete for a place in a batch.
GOOD_SHARE, PROPOSALS = 0.25, 24


def propose(finished: Sequence[tuple[float, float]], count: int, low: float, high: float, source: random.Random) -> list[float]:
    """`count` candidates between low and high, where good ones have been more frequent than others.

    finished holds (candidate, score). On a logarithmic scale, the density of the good
    trials and that of the rest are sums of bell curves around them and a flat part;
    proposals are drawn from the good density, and those with the largest ratio
    of the two are taken. Places of a batch that are already taken count as the rest.
    """
    a, b = math.log(low), math.log(high)
    ranked = sorted(finished, key=lambda f: (-(-math.inf if math.isnan(f[1]) else f[1]), f[0]))
    best = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    good, rest = ([math.log(c) for c, _ in part] for part in (ranked[:best], ranked[best:]))
    chosen: list[float] = []
    for _ in range(count):
        others = rest + chosen
        width = (b - a) / (1.0 + len(good))

        def density(x: float, places: list[float]) -> float:
            return 1.0 / (b - a) + sum(math.exp(-(((x - p) / width) ** 2) / 2.0) / width for p in places)

        drawn = []
        for _ in range(PROPOSALS):
            at = source.randrange(len(good) + 1)
            x = source.gauss(good[at], width) if at < len(good) else a
            drawn.append(x if a < x < b else source.uniform(a, b))
        chosen.append(max(drawn, key=lambda x: density(x, good) / density(x, others)))
    return [min(high, max(low, math.exp(x))) for x in chosen]


def adaptive_search(evaluate: Callable[[Sequence[float]], Sequence[float]], trials: int, low: float, high: float, seed: int,
                    batch: int = 4) -> list[tuple[float, float, int]]:
    """(candidate, score, batch) of every trial: a first batch of log-uniform draws, then
    batches proposed from all finished trials. `evaluate` scores one batch, in which
    candidates share their passes over the rows. The same seed and scores give the same trials."""
    source = random.Random(seed)
    done: list[tuple[float, float, int]] = []
    while len(done) < trials:
        count = min(batch, trials - len(done))
        if done:
            costs = propose([(c, s) for c, s, _ in done], count, low, high, source)
        else:
            costs = [math.exp(source.uniform(math.log(low), math.log(high))) for _ in range(count)]
        number = done[-1][2] + 1 if done else 0
        done += [(c, float(s), number) for c, s in zip(costs, evaluate(costs))]
    return done


def adaptive_random_search(df: DataFrame, label: str, fold_col: str, folds: int, trials: int, low: float, high: float, seed: int,
                           batch: int = 4, **fits) -> tuple[float, DataFrame]:
    """random_search with candidates proposed batch by batch: (best cost, (cost, gini, batch, best) table)."""
    def evaluate(costs: Sequence[float]) -> list[float]:
        table = random_search(df, label, fold_col, folds, costs, **fits)[1]
        return [r["gini"] for r in table.collect()]  # one row per candidate, in their order

    done = adaptive_search(evaluate, trials, low, high, seed, batch)
    best = _best([s for _, s, _ in done])
    rows = [(c, s, k, i == best) for i, (c, s, k) in enumerate(done)]
    return done[best][0], df.sparkSession.createDataFrame(rows, "cost double, gini double, batch int, best boolean")
