"""Scoring over tables with columns of earlier models, and refused labels and scores."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gradewell.operators import metrics
from gradewell.operators.binning import fit_binning, woe_transform
from gradewell.operators.calibrate import isotonic_fit
from gradewell.operators.linear import LinearScore, logistic_fit, logistic_score
from gradewell.operators.online import pa_fit
from gradewell.operators.stats import label_correlation
from gradewell.plans.jobs import score_frame


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 7), int(i % 7 + i % 3 > 5)) for i in range(200)], "id int, x double, y int")


def old_scores(df):
    return df.withColumns({
        "score": F.lit(0.9), "prediction": F.lit("old"), "calibrated": F.lit(0.1), "features": F.lit("f"), "probability": F.lit(1),
        "rawPrediction": F.lit(2), "a.b": F.lit(3),
    })


def pairs(df):
    return sorted((r["id"], round(r["score"], 9), r["prediction"]) for r in df.collect())


def test_old_score_columns_do_not_reach_the_result(rows):
    logistic = logistic_fit(rows, ["x"], "y")
    linear = PipelineModel([LinearScore(inputCols=["x"], weights=[0.5], bias=-2.0)])
    scored = linear.transform(rows)
    calibrated = PipelineModel([*linear.stages, isotonic_fit(scored, "score", "y")])
    for model in (logistic, linear, calibrated):
        plain, crowded = score_frame(model, rows), score_frame(model, old_scores(rows))
        assert pairs(plain) == pairs(crowded)
        assert crowded.columns == ["id", "x", "y", "calibrated", "features", "probability", "rawPrediction", "a.b", "score", "prediction"]
        first = crowded.first()
        assert (first["calibrated"], first["features"], first["probability"], first["a.b"]) == (0.1, "f", 1, 3)
    again = logistic_score(logistic, old_scores(rows))
    assert again.columns.count("score") == 1 and pairs(again) == pairs(logistic_score(logistic, rows))


def test_a_model_may_read_an_old_score(rows):
    crowded = rows.withColumn("score", F.col("x") * 2)
    model = logistic_fit(crowded, ["score"], "y")
    expected = {r["id"]: r["probability"][1] for r in model.transform(crowded).collect()}
    found = score_frame(model, crowded)
    assert found.columns == ["id", "x", "y", "score", "prediction"]
    assert all(math.isclose(r["score"], expected[r["id"]]) for r in found.collect())
    with pytest.raises(ValueError, match="reads and writes"):
        score_frame(PipelineModel([LinearScore(inputCols=["score"], weights=[1.0], bias=0.0)]), crowded)


def test_own_output_names(rows):
    chain = Pipeline(stages=[
        VectorAssembler(inputCols=["x"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol="y", probabilityCol="p", predictionCol="q"),
    ]).fit(rows)
    assert score_frame(chain, rows.withColumn("p", F.lit("mine"))).columns == ["id", "x", "y", "p", "score", "prediction"]


@pytest.mark.parametrize("bad", [2, -1])
def test_labels_outside_0_and_1_are_refused_by_name(spark, rows, bad):
    wrong = rows.withColumn("y", F.when(F.col("id") == 5, bad).otherwise(F.col("y"))).withColumn("c", F.col("x").cast("string"))
    for use in (
        lambda: fit_binning(wrong, ["x"], "y").table.collect(), lambda: fit_binning(wrong, ["c"], "y").table.collect(),
        lambda: metrics.auc_gini(wrong, "x", "y").collect(), lambda: metrics.single_feature_gini(wrong, ["x"], "y").collect(),
        lambda: pa_fit(wrong, ["x"], "y", ["id"]), lambda: metrics.calibration_curve(wrong.withColumn("p", F.lit(0.5)), "p", "y").collect(),
        lambda: metrics.confusion_metrics(wrong, "y", "y").collect(), lambda: isotonic_fit(wrong, "x", "y"),
    ):
        with pytest.raises(Exception, match="column 'y' must hold 0, 1 or null"):
            use()
    assert label_correlation(wrong, ["x"], "y").count() == 1  # any number will do there


def test_nan_and_out_of_range_probabilities(spark):
    df = spark.createDataFrame([(0.1, 0, 1.0), (float("nan"), 1, float("nan")), (0.95, 1, 0.0), (1.0, 1, 1.0), (None, 1, None)], "p double, y int, q double")
    curve = {r["bin"]: (r["n"], round(r["mean_prob"], 6), r["event_rate"]) for r in metrics.calibration_curve(df, "p", "y").collect()}
    assert curve == {0: (1, 0.1, 0.0), 4: (2, 0.975, 1.0)}
    row = metrics.confusion_metrics(df, "q", "y").first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 1, 0, 1)
    for p in (-0.5, 1.5):
        with pytest.raises(Exception, match="must hold probabilities"):
            metrics.calibration_curve(df.withColumn("p", F.lit(p)), "p", "y").collect()
    with pytest.raises(Exception, match="column 'q' must hold 0, 1 or null"):
        metrics.confusion_metrics(df.withColumn("q", F.lit(0.4)), "q", "y").collect()


def test_null_and_unseen_hot_categories_stay_where_they_are(spark, monkeypatch):
    """Most rows to be scored are null or of a category the fit has not seen."""
    from gradewell import workspace
    from gradewell.operators import binning

    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(binning, "MAP_CATEGORIES", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        train = spark.range(4_000).selectExpr("concat('c', id % 400) as c", "cast(id % 3 = 0 as int) as y")
        fitted = fit_binning(train, ["c"], "y")
        part = spark.range(0, 20_000, 1, 8).selectExpr(
            "id", "case when id % 10 < 7 then null when id % 10 < 9 then 'new' else concat('c', (id div 10) % 400) end as c"
        )
        scored = woe_transform(part, fitted, ["c"])
        sizes = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 4 * 20_000 / 8
        woe = {r["category"]: r["woe"] for r in fitted.table.collect()}
        for r in scored.collect():
            assert r["c_WOE"] == woe.get(r["c"], 0.0) if r["c"] else r["c_WOE"] == 0.0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
