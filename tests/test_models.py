import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from catalog.fixture import KEY, NOT_FEATURES
from gradewell import Roles
from gradewell.functions import row_hash
from gradewell.ml import GiniEvaluator, MrmrSelector, WoeEstimator
from gradewell.operators.binning import fit_binnings, woe_transform
from gradewell.operators.linear import LinearScore, assemble, balanced_weight, logistic_fit
from gradewell.operators.metrics import gini
from gradewell.operators.newton import logistic_fits
from gradewell.operators.online import pa_fit, pa_fit_many, run_rows
from gradewell.operators.search import adaptive_random_search, adaptive_search, cross_validate, log_uniform, oof_predict, param_grid_search
from gradewell.operators.split import fold_hash
from gradewell.plans.jobs import evaluate_scores, score_frame, split_job
from gradewell.plans.training import train_cross_validated, train_passive_aggressive, train_validated
from gradewell.workspace import scratch_path

ROLES = Roles("flag", ["yr", "flag"], NOT_FEATURES)
X = ["l_quantity", "l_discount"]


@pytest.fixture(scope="module")
def labelled(lines):
    return lines.where("flag is not null").select(*KEY, "l_quantity", "l_discount", "l_linestatus", "flag")


def newton(x, y, w=None):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(y)) if w is None else w
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return b


def test_logistic_matches_newton(labelled):
    frame = labelled.toPandas()
    x, y = frame[X].to_numpy(), frame["flag"].to_numpy()
    model = logistic_fit(labelled, X, "flag", tol=1e-12, max_iter=300).stages[-1]
    assert [model.intercept, *model.coefficients] == pytest.approx(newton(x, y), rel=1e-5)
    weighted = balanced_weight(labelled, "flag")
    w = weighted.select("weight").toPandas()["weight"].to_numpy()
    model = logistic_fit(weighted, X, "flag", weight="weight", tol=1e-12, max_iter=300).stages[-1]
    assert [model.intercept, *model.coefficients] == pytest.approx(newton(x, y, w), rel=1e-5)


def test_assemble_refuses_nulls(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="(?i)null"):
        assemble(df, ["a", "b"]).collect()


def pa_by_hand(x, y, cost, epochs, average, share):
    """Plain PA-II, one row after the other."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(epochs):
        total, n = np.zeros_like(w), 0
        for row, label in zip(x, y):
            row = np.append(row, 1.0)
            sign = 1.0 if label else -1.0
            loss = max(0.0, 1.0 - sign * (w @ row))
            w = w + sign * loss / (row @ row + 1.0 / (2.0 * cost * share[label])) * row
            total, n = total + w, n + 1
        if average:
            w = total / n
    return w


@pytest.mark.parametrize("average", [True, False])
@pytest.mark.parametrize("copies", [1, 3])
def test_pa_on_one_partition_is_plain_pa(spark, labelled, average, copies):
    rows = labelled.limit(300).toPandas()
    df = spark.createDataFrame(pd.concat([rows] * copies))
    model = pa_fit(df, X, "flag", KEY, cost=15.0, partitions=1, max_iter=2, tol=0.0, average=average, seed=1)
    ordered = df.withColumn("h", row_hash(KEY, 1)).orderBy("h").toPandas()
    x, y = ordered[X].to_numpy(), ordered["flag"].to_numpy()
    n, p = len(y), y.sum()
    mean, spread = x.mean(axis=0), x.std(axis=0)
    want = pa_by_hand((x - mean) / spread, y, 15.0, 2, average, [n / (2 * (n - p)), n / (2 * p)])
    slope = want[:-1] / spread
    got = [*model.getOrDefault("weights"), model.getOrDefault("bias")]
    assert got == pytest.approx([*slope, want[-1] - slope @ mean], rel=1e-8)


def test_copies_in_closed_form():
    random = np.random.default_rng(0)
    x = np.column_stack([random.normal(size=(5, 3)), np.ones(5)])
    y, m = np.array([1.0, -1, 1, -1, 1]), np.array([1, 4, 2, 1, 50])
    inverse = np.array([[0.5, 0.01], [0.2, 0.03]])
    a, ta, b, tb = (np.zeros((2, 4)) for _ in range(4))
    run_rows(a, ta, x, y, m, inverse)
    run_rows(b, tb, np.repeat(x, m, axis=0), np.repeat(y, m), np.ones(m.sum(), dtype=int), inverse)
    assert np.allclose(a, b) and np.allclose(ta, tb)


def test_pa_does_not_depend_on_layout_and_separates(labelled):
    one = pa_fit_many(labelled, X, "flag", KEY, [1.0, 15.0], partitions=4, max_iter=3)
    two = pa_fit_many(labelled.repartition(9), X, "flag", KEY, [1.0, 15.0], partitions=4, max_iter=3)
    for a, b in zip(one, two):
        assert a.getOrDefault("weights") == pytest.approx(b.getOrDefault("weights"), rel=1e-9)
        assert gini(a.transform(labelled), "score", "flag") > 0.7
    alone = pa_fit(labelled, X, "flag", KEY, cost=15.0, partitions=4, max_iter=3)
    assert alone.getOrDefault("weights") == pytest.approx(one[1].getOrDefault("weights"), rel=1e-9)


def test_pa_refuses_nulls(lines):
    with pytest.raises(Exception, match="a feature is null"):
        pa_fit(lines, ["l_tax"], "flag", KEY, max_iter=1)


def test_linear_score(spark, tmp_path):
    model = LinearScore(inputCols=["a", "b"], weights=[1.0, -2.0], bias=0.5)
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "a double, b double")
    got = model.transform(df).collect()
    assert [r.score for r in got] == pytest.approx([1 / (1 + np.exp(-1.5)), 1 / (1 + np.exp(1.5))])
    assert [r.prediction for r in got] == [1.0, 0.0]
    model.write().overwrite().save(str(tmp_path / "m"))
    assert LinearScore.load(str(tmp_path / "m")).transform(df).collect() == got


def test_log_uniform():
    draws = log_uniform(200, 10.0, 20.0, 1)
    assert draws == log_uniform(200, 10.0, 20.0, 1) and all(10 <= d <= 20 for d in draws)
    assert abs(np.mean(np.log(draws)) - np.log(200) / 2) < 0.05


def test_oof_never_scores_rows_it_was_fitted_on(labelled):
    rows = fold_hash(labelled, KEY, 3, 0)
    seen = []

    def fit(train):
        folds = {r.fold for r in train.select("fold").distinct().collect()}
        seen.append(folds)
        return lambda part: part.withColumn("fitted_on", F.lit(",".join(map(str, sorted(folds)))))

    scored = oof_predict(rows, "fold", 3, fit)
    assert scored.count() == rows.count() and seen == [{1, 2}, {0, 2}, {0, 1}]
    assert scored.where(F.col("fitted_on").contains(F.col("fold").cast("string"))).count() == 0


def chain():
    woe = WoeEstimator(inputCols=[*X, "l_linestatus"], labelCol="flag", bins=5)
    mrmr = MrmrSelector(inputCols=woe.woe_columns(), numFeatures=2, labelCol="flag")
    regression = LogisticRegression(labelCol="flag")
    grid = ParamGridBuilder().addGrid(regression.regParam, [0.01, 0.9]).addGrid(regression.elasticNetParam, [1.0]).build()
    return Pipeline(stages=[woe, mrmr, regression]), grid


def test_cross_validation_refits_every_stage(labelled):
    rows = fold_hash(labelled, KEY, 2, 0)
    pipeline, grid = chain()
    evaluator = GiniEvaluator(labelCol="flag")
    model, score, table = cross_validate(rows, pipeline, grid, evaluator, "fold", 2)
    by_hand = np.mean([
        evaluator.evaluate(pipeline.copy(grid[0]).fit(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i)))
        for i in (0, 1)
    ])
    got = table.orderBy("point").collect()
    assert got[0].score == pytest.approx(by_hand) and score == got[0].score
    assert [r.best for r in got] == [True, False] and got[1].score == 0.0  # everything penalised away
    assert model.stages[-1].getOrDefault("regParam") == 0.01


def test_grid_on_a_fixed_part(labelled):
    rows = fold_hash(labelled, KEY, 4, 0)
    pipeline, grid = chain()
    train, dev = rows.where("fold > 0"), rows.where("fold = 0")
    model, score, table = param_grid_search(train, dev, pipeline, list(reversed(grid)), GiniEvaluator(labelCol="flag"))
    assert score == pytest.approx(GiniEvaluator(labelCol="flag").evaluate(model.transform(dev)))
    assert [r.best for r in table.orderBy("point").collect()] == [False, True]


def test_split_job_writes_parts(spark, lines):
    path = scratch_path(spark, "job")
    counts = {r.split: r.n_rows for r in split_job(lines, ROLES, path, 0.9, 34, KEY, exact=True).collect()}
    assert sum(counts.values()) == lines.where("flag is not null").count()
    assert sum(r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()) == sum(counts.values())


def test_fixed_part_run_and_reload(spark, lines):
    card = train_validated(lines, ROLES, KEY, num_features=4, val_size=0.3, tuning=True, bins=5, filter_correlation=True)
    assert card.metrics["gini"] > 0.6 and len(card.features) == 4 and card.search.count() == 2
    path = scratch_path(spark, "card")
    card.model.write().overwrite().save(path)
    a, b = (score_frame(m, lines).orderBy(*KEY, "hs").select("score", "prediction").collect() for m in (card.model, PipelineModel.load(path)))
    assert a == b
    tables = evaluate_scores(score_frame(card.model, lines), "flag")
    assert tables["rank"].first().gini > 0.7 and tables["distribution"].count() == 3
    assert sum(r.n for r in tables["calibration"].collect()) == tables["rank"].first().n


def test_cross_validated_run(lines):
    card = train_cross_validated(lines, ROLES, KEY, num_features=3, folds=2, bins=5)
    assert card.metrics["gini"] > 0.6 and card.search.collect()[0].best


def test_passive_aggressive_run(lines):
    card = train_passive_aggressive(lines, ROLES, KEY, num_features=4, trials=3, folds=2, bins=5, partitions=2, max_iter=3)
    assert card.metrics["train_gini"] > 0.6 and 10 <= card.metrics["C"] <= 20 and card.search.count() == 3
    scored = score_frame(card.model, lines.where("flag is not null"))
    mean, rate = scored.agg(F.avg("score"), F.avg("flag")).first()
    assert mean == pytest.approx(rate, abs=0.02)  # calibrated


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """What a task runs must load where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from gradewell.operators.monotone import best_partition

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((run_rows, best_partition)))
    code = "import pickle; rows, best = pickle.load(open('f.pkl', 'rb')); print(best([1, 2], [4, 4], 3, 5)[1])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[0, 1]", done.stderr


def test_adaptive_search_beats_plain_draws():
    """A peak in a wide range: on average over seeds, proposals come closer than as many log-uniform draws."""
    def score(cost):
        return -abs(math.log(cost / 37.0))

    gains = []
    for seed in range(40):
        done = adaptive_search(lambda costs: [score(c) for c in costs], 20, 0.01, 10_000.0, seed)
        assert done == adaptive_search(lambda costs: [score(c) for c in costs], 20, 0.01, 10_000.0, seed)
        assert len(done) == 20 and [k for _, _, k in done] == sorted(list(range(5)) * 4) and all(0.01 <= c <= 10_000.0 for c, _, _ in done)
        gains.append(max(s for _, s, _ in done) - max(score(c) for c in log_uniform(20, 0.01, 10_000.0, seed)))
    assert np.mean(gains) > 0.1 and np.mean(np.array(gains) > 0) > 0.6


def test_adaptive_search_over_folds(labelled):
    rows = fold_hash(labelled, KEY, 3, 9)

    def fit_folds(table, costs):
        fitted = fit_binnings(table, ["l_quantity"], "flag", [{"bins": max(2, int(c))} for c in costs], "fold", 3)

        def scorer(binnings):
            def add(part):
                for i, one in enumerate(binnings):
                    part = woe_transform(part, one).withColumn(f"score_{i}", -F.col("l_quantity_WOE")).drop("l_quantity_WOE")
                return part

            return add

        return [scorer(b) for b in fitted]

    best, table = adaptive_random_search(rows, "flag", "fold", 3, 5, 2.0, 30.0, 1, batch=3, fit_folds=fit_folds)
    found = table.collect()
    assert [r["batch"] for r in found] == [0, 0, 0, 1, 1] and sum(r["best"] for r in found) == 1
    assert best == max(found, key=lambda r: r["gini"])["cost"] and all(0.3 < r["gini"] < 1 for r in found)


POINTS = [(0.0, 0.0), (0.01, 0.5), (0.1, 0.5), (0.05, 0.0), (0.02, 1.0)]


def test_joint_logistic_fits_equal_single_ones(labelled):
    """All penalties and folds together against the built-in regression, one by one."""
    rows = fold_hash(labelled.withColumn("z", F.col("l_quantity") * F.col("l_discount")).withColumn("c", F.lit(3.0)), KEY, 2, 4)
    names = [*X, "z", "c"]
    found = logistic_fits(rows, names, "flag", POINTS, "fold", 2)
    whole = logistic_fits(rows, names, "flag", POINTS)[0]
    for train, models in [(rows.where("fold != 0"), found[0]), (rows.where("fold != 1"), found[1]), (rows, whole)]:
        vectors = assemble(train, names).persist()
        for (reg, elastic), model in zip(POINTS, models):
            one = LogisticRegression(labelCol="flag", regParam=reg, elasticNetParam=elastic, tol=1e-12, maxIter=500).fit(vectors)
            spread = np.array([*train.select(*[F.stddev(c) for c in names]).first()])
            got, want = np.array(model.getOrDefault("weights")) * spread, one.coefficients.toArray() * spread
            assert np.abs(got - want).max() < 2e-4 and abs(model.getOrDefault("bias") - one.intercept) < 2e-3
        vectors.unpersist()


def test_grid_of_penalties_is_scored_together(labelled):
    """The same scores and the same best model as fits of single points."""
    train, dev = (fold_hash(labelled, KEY, 3, 2).where(c) for c in ("fold != 0", "fold = 0"))
    regression = LogisticRegression(labelCol="flag")
    pipeline = Pipeline(stages=[MrmrSelector(inputCols=X, numFeatures=2, labelCol="flag"), regression])
    grid = ParamGridBuilder().addGrid(regression.regParam, [0.01, 0.1, 0.6]).addGrid(regression.elasticNetParam, [0.5, 1.0]).build()
    judge = GiniEvaluator(labelCol="flag")
    model, score, table = param_grid_search(train, dev, pipeline, grid, judge)
    for point, r in zip(grid, table.orderBy("point").collect()):
        alone = judge.evaluate(pipeline.fit(train, point).transform(dev))
        assert r["score"] == pytest.approx(alone, abs=2e-3)
    assert judge.evaluate(model.transform(dev)) == pytest.approx(score, abs=2e-3)


@pytest.mark.parametrize("grid", [[{}], [0.01, 0.1]])
def test_search_holds_only_the_columns_that_are_read(labelled, monkeypatch, grid):
    seen = []
    kept = lambda part: seen.append(part.columns) or part
    monkeypatch.setattr(type(labelled), "persist", kept)
    monkeypatch.setattr(type(labelled), "unpersist", lambda part: part)
    regression = LogisticRegression(featuresCol="features", labelCol="flag")
    points = [{regression.regParam: p} if p else {} for p in grid]
    chain = Pipeline(stages=[MrmrSelector(inputCols=X, numFeatures=1, labelCol="flag"), regression])
    model, _, table = param_grid_search(labelled, labelled, chain, points, GiniEvaluator(labelCol="flag"))
    assert table.count() == len(grid) and "prediction" in model.transform(labelled).columns
    assert ["flag", "features"] in seen and not any("l_linestatus" in columns for columns in seen)
