import numpy as np
import pandas as pd
import pytest

from catalog.fixture import NUMERIC
from gradewell.ml import GiniEvaluator
from gradewell.operators import calibrate, metrics
from gradewell.operators.calibrate import IsotonicModel, isotonic_calibrate, isotonic_fit, pooled_blocks
from gradewell.operators.metrics import (
    auc_gini, calibration_curve, confusion_metrics, gini, gini_hard, ks_statistic, rank_metrics, single_feature_gini,
)


def brute_auc(x, y):
    pos, neg = x[y == 1], x[y == 0]
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


def brute_ks(x, y):
    return max(abs((x[y == 0] <= t).mean() - (x[y == 1] <= t).mean()) for t in np.unique(x))


@pytest.fixture(scope="module")
def scored(spark):
    random = np.random.default_rng(1)
    y = (random.random(900) < 0.3).astype(int)
    x = np.round(random.normal(size=900) + y, 1)
    x[:300] = 0.5  # a third of all rows share one score
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(5), x, y


@pytest.mark.parametrize("cells", [1 << 16, 64, 4, 1])
def test_ranges_do_not_change_the_result(scored, cells):
    df, x, y = scored
    r = rank_metrics(df, "x", "y", cells).first()
    assert (r.n, r.events) == (900, y.sum())
    assert r.auc == pytest.approx(brute_auc(x, y), abs=1e-12)
    assert r.ks == pytest.approx(brute_ks(x, y), abs=1e-12)
    assert r.gini == pytest.approx(2 * r.auc - 1)


def test_reversed_score(scored):
    df, _, _ = scored
    assert gini(df.selectExpr("-x as x", "y"), "x", "y") == pytest.approx(-gini(df, "x", "y"))


def test_degenerate_scores(spark):
    tied = spark.createDataFrame([(0.2, 1), (0.2, 0), (0.2, 0)], "score double, label int")
    assert auc_gini(tied, "score", "label").first().auc == 0.5 and ks_statistic(tied, "score", "label").first().ks == 0.0
    one = tied.where("label = 0")
    assert auc_gini(one, "score", "label").first().auc is None and ks_statistic(one, "score", "label").first().ks is None
    assert gini(tied.limit(0), "score", "label") is None
    holes = spark.createDataFrame([(None, 1), (float("nan"), 0), (0.1, 0), (0.9, 1), (0.5, None)], "score double, label int")
    assert tuple(auc_gini(holes, "score", "label").first()) == (2, 1, 1.0, 1.0)


@pytest.mark.parametrize("cells", [1 << 16, 8])
def test_features_as_scores(lines, lines_pd, cells):
    got = {r.feature: r for r in single_feature_gini(lines, NUMERIC, "flag", cells).collect()}
    for c in NUMERIC:
        known = lines_pd[[c, "flag"]].dropna()
        x, y = known[c].to_numpy(dtype=float), known["flag"].to_numpy()
        assert got[c].auc == pytest.approx(brute_auc(x, y), abs=1e-12) and got[c].n == len(known)
        assert got[c].ks == pytest.approx(brute_ks(x, y), abs=1e-12)


def test_hard_predictions(spark):
    # two of three events found, one of three non-events flagged
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)], "prediction double, label double")
    assert gini_hard(df, "prediction", "label").first().gini == pytest.approx(1 / 3)
    r = confusion_metrics(df, "prediction", "label").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 2, 1)
    assert (r.accuracy, r.precision, r.recall, r.f1, r.roc_auc) == pytest.approx((2 / 3,) * 5)
    assert GiniEvaluator(scoreCol="prediction").evaluate(df) == pytest.approx(1 / 3)
    assert gini_hard(df.where("label = 1"), "prediction", "label").first().gini is None


def test_calibration_curve_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.2, 1), (0.999, 1), (1.0, 1), (None, 1)], "p double, y int")
    got = {r.bin: (r.n, r.event_rate) for r in calibration_curve(df, "p", "y").collect()}
    assert got == {0: (1, 0.0), 1: (1, 1.0), 4: (2, 1.0)}


def pooled(rates, weights):
    """Pool adjacent violators."""
    blocks = []
    for r, w in zip(rates, weights):
        blocks.append([r * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return [s / w for s, w, n in blocks for _ in range(n)]


def test_isotonic_matches_pooling(scored):
    df, x, y = scored
    frame = pd.DataFrame({"x": x, "y": y}).groupby("x").y.agg(["mean", "size"]).sort_index()
    want = dict(zip(frame.index, pooled(frame["mean"], frame["size"])))
    for r in isotonic_calibrate(df, "x", "y").distinct().collect():
        assert r.calibrated == pytest.approx(want[r.x], abs=1e-12)
    model = isotonic_fit(df, "x", "y")
    ends = model.transform(df.sparkSession.createDataFrame([(-99.0,), (99.0,)], "x double")).collect()
    assert [r.calibrated for r in ends] == pytest.approx([want[x.min()], want[x.max()]])


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_pooled_blocks_do_not_depend_on_ranges(spark, ranges):
    """Rising, falling, flat and noisy stretches, also across the borders of ranges."""
    random = np.random.default_rng(9)
    n = random.integers(1, 6, 1_200)
    wave = 0.5 + 0.4 * np.sin(np.arange(1_200) / 150.0) + np.where(np.arange(1_200) > 800, -0.4, 0.0)
    events = random.binomial(n, np.clip(wave, 0, 1))
    frame = pd.DataFrame({"score": np.arange(1_200) / 7.0 - 80, "n": n, "events": events})
    want = pooled(pd.Series(events / n), pd.Series(n))
    blocks = pooled_blocks(spark.createDataFrame(frame).repartition(5), ranges).orderBy("low").collect()
    assert sum(b["n"] for b in blocks) == n.sum() and len({round(v, 12) for v in want}) <= len(blocks) <= 1_200
    got = np.concatenate([np.full(((frame.score >= b["low"]) & (frame.score <= b["high"])).sum(), b["events"] / b["n"]) for b in blocks])
    assert np.allclose(got, want, atol=1e-12)


def test_many_blocks_are_looked_up_by_cells(spark, scored, tmp_path, monkeypatch):
    """Between, inside, before and behind the blocks, with nulls: the same from lists of cells as from arrays, and after reloading."""
    df, x, _ = scored
    model = isotonic_fit(df, "x", "y")
    probe = spark.createDataFrame([(float(v),) for v in np.r_[x[::7], x[::9] + 0.033, -50, 50, 0.0, -0.0]] + [(None,), (float("nan"),)], "x double")
    few = sorted(map(tuple, model.transform(probe).select("x", "calibrated").collect()), key=str)  # nan is not itself: compared as text
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = sorted(map(tuple, IsotonicModel.load(path).transform(probe).select("x", "calibrated").collect()), key=str)
    assert str(again) == str(few)
    monkeypatch.setattr(calibrate, "BROADCAST_ROWS", 2)
    many = sorted(map(tuple, model.transform(probe).select("x", "calibrated").collect()), key=str)
    assert [r[1] is None for r in few] == [r[1] is None for r in many] and sum(r[1] is None for r in few) == 2
    assert [r[1] for r in many if r[1] is not None] == pytest.approx([r[1] for r in few if r[1] is not None], abs=1e-12)


def test_tasks_hold_a_bounded_number_of_values():
    """All features together, however many values they have."""
    held = [metrics._Held() for _ in range(7)]
    values = np.random.default_rng(3).normal(size=(200_000, 7))
    label, handed = np.zeros(1000, np.int64), 0
    for low in range(0, len(values), 1000):
        for f, one in enumerate(held):
            one.add(metrics.ordered_bits(values[low : low + 1000, f].copy()), label, 64)
        handed += sum(held[f].take().shape[1] for f in metrics._too_many(held))
        assert sum(one.size for one in held) <= metrics.HELD
    assert handed + sum(one.take().shape[1] for one in held) == values.size


def test_values_are_ranked_by_spark(scored):
    """Python workers count, but get no group of cells back."""
    df, _, _ = scored
    cells = [np.unique(metrics.ordered_bits(df.select("x").toPandas()["x"].to_numpy()) >> 44)]
    ranked = metrics._ranked_cells(df, 1, 20, cells, {0: (1, 1)})
    assert ranked._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
