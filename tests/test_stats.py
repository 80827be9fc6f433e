from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from catalog.fixture import NUMERIC
from gradewell.operators import select, stats
from gradewell.operators.sums import exact_sum
from gradewell.operators.select import (
    drop_correlated, greedy_mrmr, kept_features, low_corr_filter, mrmr_select, smart_correlated, top_corr_select,
)


@pytest.fixture(scope="module")
def wide(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 6))
    x[:, 1] = 1e6 + x[:, 0] * 2 + random.normal(size=400)  # large offset
    x[:, 2] = 5.0
    x[:, 3] = np.nan
    x[random.random(400) < 0.3, 4] = np.nan
    frame = pd.DataFrame(x, columns=list("abcdef"))
    frame["y"] = (x[:, 0] + random.normal(size=400) > 0.3).astype(int)
    return spark.createDataFrame(frame).repartition(3), frame


def test_pairwise_matches_pandas(wide):
    df, frame = wide
    want = frame[list("abcdef")].corr()
    got = {(r.feature_a, r.feature_b): r for r in stats.pairwise_correlation(df, list("abcdef")).collect()}
    assert len(got) == 15
    for (a, b), r in got.items():
        assert r.n == (frame[a].notna() & frame[b].notna()).sum()
        if np.isnan(want.loc[a, b]):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_label_correlation_in_chunks(wide, monkeypatch):
    df, frame = wide
    monkeypatch.setattr(stats, "COLUMNS_PER_PASS", 4)
    got = {r.feature: r["corr"] for r in stats.label_correlation(df, list("abcdef"), "y").collect()}
    for c in "abef":
        assert got[c] == pytest.approx(frame[c].corr(frame["y"]), abs=1e-9)
    assert got["c"] is None and got["d"] is None


def test_f_matches_definition(wide):
    df, frame = wide
    got = {r.feature: r.f for r in stats.f_statistic(df, list("abcdef"), "y").collect()}
    for c in "abef":
        groups = [g[c].dropna() for _, g in frame.groupby("y")]
        pooled = pd.concat(groups)
        between = sum(len(g) * (g.mean() - pooled.mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[c] == pytest.approx(between / (within / (len(pooled) - 2)), rel=1e-7)
    assert got["c"] is None


def test_edge_columns(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, None, 0), (None, None, 1)], "a double, b double, y int")
    got = {r.feature: (r.n, r["corr"]) for r in stats.label_correlation(df, ["a", "b"], "y").collect()}
    assert got["a"] == (2, pytest.approx(-1.0)) and got["b"] == (0, None)
    assert all(r["corr"] is None for r in stats.pairwise_correlation(df.limit(0), ["a", "b"]).collect())


def test_a_constant_is_undefined_in_any_layout(spark):
    """0.1 added up in uneven parts leaves a residue that must not pass for a variance."""
    rows = spark.range(997).selectExpr("0.1 as c", "cast(id % 2 as int) as y", "cast(id as double) as v").selectExpr("cast(c as double) as c", "y", "v")
    for parts in (1, 3, 7):
        df = rows.repartition(parts)
        assert {r.feature: r["corr"] is None for r in stats.label_correlation(df, ["c", "v"], "y").collect()} == {"c": True, "v": False}
        assert {r.feature: r.f is None for r in stats.f_statistic(df, ["c", "v"], "y").collect()} == {"c": True, "v": False}
        assert stats.pairwise_correlation(df, ["c", "v"]).first()["corr"] is None
        assert {r.feature: r["var"] == 0.0 for r in stats.variances(df, ["c", "v"]).collect()} == {"c": True, "v": False}


def test_selectors(lines):
    labelled = lines.where("flag is not null")
    assert [r.feature for r in low_corr_filter(labelled, NUMERIC, "flag").orderBy("rank").collect()] == ["l_quantity", "l_discount"]
    assert low_corr_filter(labelled, NUMERIC[:2], "flag").count() == 0
    top = top_corr_select(labelled, [*NUMERIC[:4], "l_linestatus", "c_mktsegment"], "flag").orderBy("rank").collect()
    assert [(r.rank, r.feature) for r in top] == [(1, "l_quantity"), (2, "l_linestatus"), (3, "c_mktsegment")]
    assert [r.feature for r in top_corr_select(labelled, ["l_linestatus"], "flag").collect()] == ["l_linestatus"]
    assert "price2" not in kept_features(drop_correlated(labelled, NUMERIC))
    smart = kept_features(smart_correlated(labelled, NUMERIC))
    assert "price2" in smart and "l_extendedprice" not in smart


def test_chain_of_correlations_keeps_first_and_third():
    assert select._keep_first(["a", "b", "c"], {"a": {"b"}, "b": {"a", "c"}, "c": {"b"}}) == {"a", "c"}


def test_mrmr_matches_brute_force(wide):
    df, frame = wide
    names = list("abef")
    relevance = {r.feature: r.f for r in stats.f_statistic(df, names, "y").collect()}
    corr = frame[names].corr().abs()
    chosen = []
    while len(chosen) < 4:
        rest = [c for c in names if c not in chosen]
        chosen.append(max(rest, key=lambda c: relevance[c] / (corr.loc[c, chosen].mean() if chosen else 1.0)))
    assert [r.feature for r in mrmr_select(df, list("abcdef"), "y", 10).orderBy("rank").collect()] == chosen
    assert greedy_mrmr({}, lambda taken, others: {}, 3) == []


def test_more_features_than_one_block(wide, monkeypatch):
    """Pairs by blocks, and correlations with each chosen feature, give the same as one scan."""
    df, frame = wide
    names = list("abcdef")
    whole = {(r.feature_a, r.feature_b): (r.n, r["corr"]) for r in stats.pairwise_correlation(df, names).collect()}
    picks = [tuple(r) for r in mrmr_select(df, names, "y", 4).orderBy("rank").collect()]
    kept = kept_features(drop_correlated(df, names, 0.3))
    for module in (stats, select):
        monkeypatch.setattr(module, "BLOCK", 2)
    parts = {(r.feature_a, r.feature_b): (r.n, r["corr"]) for r in stats.pairwise_correlation(df, names).collect()}
    assert set(parts) == set(whole) and len(parts) == 15
    for pair, (n, corr) in whole.items():
        assert parts[pair][0] == n and parts[pair][1] == (corr if corr is None else pytest.approx(corr, abs=1e-12))
    again = [tuple(r) for r in mrmr_select(df, names, "y", 4).orderBy("rank").collect()]
    assert [p[:2] for p in again] == [p[:2] for p in picks] and [p[2] for p in again] == pytest.approx([p[2] for p in picks])
    assert kept_features(drop_correlated(df, names, 0.3)) == kept


def test_correlation_scan_keeps_its_tasks(spark):
    df = spark.range(0, 1_000, 1, 64).selectExpr("cast(id as double) as a", "cast(id % 7 as double) as b")
    plan = stats.pairwise_correlation(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "SinglePartition" not in plan and "Window" not in plan


def test_sums_are_the_same_in_any_layout(spark):
    """Values of very different sizes, far from zero, with nulls: the same doubles for 1 to 64 partitions."""
    random = np.random.default_rng(5)
    n = 5_000
    frame = pd.DataFrame({
        "a": random.normal(size=n) * 10.0 ** random.integers(-6, 6, n), "b": 1e9 + random.normal(size=n),
        "c": np.where(random.random(n) < 0.2, np.nan, random.exponential(size=n)), "d": np.r_[1e12, random.random(n - 1)],
        "y": random.integers(0, 2, n),
    })
    frame["a2"] = 2 * frame["a"]
    df = spark.createDataFrame(frame)
    names = ["a", "b", "c", "d", "a2"]
    seen = set()
    for parts in (1, 2, 5, 16, 64):
        rows = stats.label_correlation(df.repartition(parts), names, "y").collect()
        seen.add(tuple((r.feature, r.n, r["corr"]) for r in rows))
    assert len(seen) == 1
    got = {f: c for f, _, c in seen.pop()}
    assert got["a"] == got["a2"]
    for c in names[:3]:
        assert got[c] == pytest.approx(frame[c].corr(frame["y"]), abs=1e-7)
    x = [Fraction(v) for v in frame["d"]]
    y = [Fraction(int(v)) for v in frame["y"]]
    mx, my = sum(x) / n, sum(y) / n
    cov = sum((p - mx) * (q - my) for p, q in zip(x, y))
    exact = float(cov) / (float(sum((p - mx) ** 2 for p in x)) ** 0.5 * float(sum((q - my) ** 2 for q in y)) ** 0.5)
    assert got["d"] == pytest.approx(exact, abs=1e-7)


def test_exact_sum_is_the_rounded_true_sum(spark):
    random = np.random.default_rng(6)
    values = (random.normal(size=3_000) * 10.0 ** random.integers(-3, 4, 3_000)).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bound, true = max(map(abs, values)), float(sum(map(Fraction, values)))
    for rows in (3_000, 10**9):
        got = {df.repartition(p).agg(exact_sum(df["v"], bound, rows)).first()[0] for p in (1, 4, 9)}
        assert len(got) == 1 and got.pop() == pytest.approx(true, rel=1e-15)
    assert df.agg(exact_sum(df["v"] * 0.0, 0.0, 10)).first()[0] == 0.0


def test_equal_correlations_are_ranked_by_name(spark):
    """z is twice a: the same correlation, whatever the last digits say."""
    random = np.random.default_rng(7)
    frame = pd.DataFrame({"z": random.random(2_000) * 1e5, "m": random.random(2_000)})
    frame["a"], frame["y"] = frame["z"] / 2, random.integers(0, 2, 2_000)
    df = spark.createDataFrame(frame)
    for parts in (1, 3, 8):
        ranked = top_corr_select(df.repartition(parts), ["z", "m", "a"], "y", 1.0).orderBy("rank").collect()
        order = [r.feature for r in ranked]
        assert order.index("a") + 1 == order.index("z")
    assert [c for c, _ in greedy_mrmr({"z": 1.0 + 1e-15, "a": 1.0, "m": 0.5}, lambda taken, others: dict.fromkeys(others, 0.5), 3)] == ["a", "z", "m"]


def test_correlations_of_training_sets_from_one_count(spark):
    """Added up once by fold, each set's correlations are those of its own rows; also where one fold is far off."""
    random = np.random.default_rng(8)
    n = 3_000
    frame = pd.DataFrame({
        "a": random.normal(size=n), "b": np.where(random.random(n) < 0.2, np.nan, random.normal(size=n)), "fold": random.integers(0, 3, n),
        "y": random.integers(0, 2, n), "d": 4.0,
    })
    frame["c"] = np.where(frame["fold"] == 1, 1e3, 0.0) + random.normal(size=n)
    df, names = spark.createDataFrame(frame).repartition(4), ["a", "b", "c", "d"]
    for t, table in enumerate(stats.correlation_sets(df, names, "y", "fold", 3)):
        mine = frame[frame["fold"] != t]
        for r in table.collect():
            assert r["n"] == mine[r["feature"]].notna().sum()
            if r["feature"] == "d":
                assert r["corr"] is None
            else:
                assert r["corr"] == pytest.approx(mine[r["feature"]].corr(mine["y"]), abs=1e-6)
