"""Runs with exact folds and splits, their reports, the preprocess hook, scratch space and plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.fixture import CATEGORICAL, KEY, NOT_FEATURES, NUMERIC, TARGET
from gradewell import Roles
from gradewell.operators import quantiles
from gradewell.operators.calibrate import isotonic_fit
from gradewell.operators.metrics import auc_gini
from gradewell.plans.jobs import split_job
from gradewell.plans.training import train_cross_validated, train_passive_aggressive, train_validated
from gradewell.workspace import scratch_path


@pytest.fixture(scope="module")
def few(lines):
    return lines.select(*KEY, "yr", "l_quantity", "l_discount", "l_linestatus", TARGET)


ROLES = Roles(TARGET, ["yr", TARGET], [*KEY, "yr"])


def test_runs_with_exact_parts_and_their_reports(few):
    runs = [
        train_cross_validated(few, ROLES, KEY, num_features=2, bins=5, trend="none", exact_folds=True),
        train_validated(few, ROLES, KEY, num_features=2, bins=5, trend="none", val_size=0.2, exact_split=True),
        train_passive_aggressive(few, ROLES, KEY, num_features=2, trials=2, bins=5, max_iter=2, exact_folds=True),
    ]
    for card in runs:
        assert 0.5 < card.metrics["gini"] < 1 and 0.5 < card.metrics["train_gini"] < 1
        rows = {(r["kind"], r["name"]): r["value"] for r in card.report("run-1").collect()}
        assert rows["metric", "gini"] == repr(card.metrics["gini"]) and rows["param", "feature_1"] == card.features[0]
        assert ("param", "exact_split") in rows or rows["param", "exact_folds"] == "True"


def test_preprocess_hook_and_missing_targets(spark, lines):
    source = lines.select(*KEY, "l_quantity", TARGET)
    seen = split_job(
        source, Roles(TARGET), scratch_path(spark, "hook"), 0.5, 1, KEY, preprocess=lambda df: df.where("l_quantity > 25").withColumn("twice", F.col("l_quantity") * 2)
    ).collect()
    assert sum(r["n_rows"] for r in seen) == source.where(f"l_quantity > 25 and {TARGET} is not null").count()
    assert {r["n_columns"] for r in seen} == {len(source.columns) + 1}


def test_isotonic_on_many_distinct_scores(spark):
    """150,000 distinct scores against pooling in plain numpy."""
    rng = np.random.default_rng(0)
    x = np.arange(150_000) / 150_000.0
    y = (rng.random(len(x)) < 0.2 + 0.5 * x**2).astype(int)
    model = isotonic_fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(6), "x", "y")
    sums, sizes = [], []
    for v in y:
        sums.append(float(v))
        sizes.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
            sums[-2:], sizes[-2:] = [sums[-2] + sums[-1]], [sizes[-2] + sizes[-1]]
    expected = np.repeat(np.array(sums) / sizes, sizes)
    at = rng.integers(0, len(x), 2_000)
    probe = spark.createDataFrame(pd.DataFrame({"i": at, "x": x[at]}))
    found = model.transform(probe).toPandas()
    assert np.allclose(found["calibrated"].to_numpy(), expected[found["i"].to_numpy()], atol=1e-9)
    assert model.boundaries.size < 2_000  # what the model keeps are pooled blocks


def test_no_plan_gathers_rows_in_one_task(few):
    counts = quantiles._cell_counts(few, ["l_quantity"], 0, 20, None)
    assert "SinglePartition" not in counts._jdf.queryExecution().executedPlan().toString()
    assert auc_gini(few, "l_quantity", TARGET).count() == 1


def test_columns_of_the_fixture(lines):
    assert set(NUMERIC + CATEGORICAL + NOT_FEATURES + [TARGET]) == set(lines.columns)


def test_scratch_space_is_left_empty():
    """Staged tables and checkpoints of an application go with it (in a session of its own)."""
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    shared = tempfile.mkdtemp(prefix="shared-")
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from gradewell.workspace import clear_scratch, pinned, staged
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
assert pinned(staged(spark.range(100))).count() == 100
clear_scratch(spark)
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    left = [p for p in Path(shared).rglob("*") if p.is_file()]
    assert not left, left
