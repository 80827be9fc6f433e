import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from catalog.fixture import FEATURES, KEY, NUMERIC
from gradewell.functions.weights import bin_iv, bin_woe
from gradewell.operators import binning, quantiles
from gradewell.operators.binning import Binning, fit_binning, fit_binnings, iv_table, woe_transform
from gradewell.operators.monotone import best_partition
from gradewell.operators.quantiles import fold_edges, quantile_edges, woe_prebin
from gradewell.operators.split import fold_hash
from gradewell.operators.state import BinState
from gradewell.workspace import scratch_path


def exact_edges(values, bins):
    x = np.sort(values[~np.isnan(values)])
    return sorted({x[-(-i * len(x) // bins) - 1] for i in range(1, bins)} - {x.max()})


@pytest.mark.parametrize("bins", [2, 5, 20])
def test_edges_are_exact_quantiles(lines, lines_pd, bins):
    got = quantile_edges(lines, NUMERIC, bins)
    for c in NUMERIC:
        assert got[c] == exact_edges(lines_pd[c].to_numpy(dtype=float), bins), c
    assert quantile_edges(lines.repartition(7), NUMERIC, bins) == got


def test_edges_of_awkward_values(spark):
    """Signs, zeros, infinities, neighbouring doubles and long runs of one value."""
    values = [-np.inf, -1e300, -2.0, -1.0, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2), 3.0, 1e300, np.inf]
    x = np.array(values * 3 + [1.0] * 40 + [float("nan")] * 5)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x})).repartition(3)
    for c, v in (("x", x), ("y", -x)):
        for bins in (2, 5, 20):
            got = quantile_edges(df, [c], bins)[c]
            assert got == exact_edges(v, bins)
            near = quantile_edges(df, [c], bins, exact=False)[c]
            assert all(any(e <= a <= e + abs(e) * 1e-6 + 1e-300 for e in got) for a in near)


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 1.0, 0)], "e double, c double, y int")
    assert quantile_edges(df, ["e", "c"], 4) == {"e": [], "c": []}
    assert woe_prebin(df, ["e", "c"]).count() == 0
    table = {r.feature: r for r in fit_binning(df, ["e", "c"], "y").table.collect()}
    assert table["e"].is_missing and table["e"].n == 2 and table["c"].iv == 0.0


def test_pure_bins_are_padded(spark):
    rows = [(1.0, 0)] * 4 + [(2.0, 1)] * 3 + [(3.0, 0), (3.0, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    table = fit_binning(df, ["x"], "y", bins=9).table.orderBy("bin").collect()
    assert [(r.n, r.events) for r in table] == [(4, 0), (3, 3), (2, 1)]
    assert table[0].woe == pytest.approx(math.log((4.5 / 5) / (0.5 / 4)))
    assert table[1].woe == pytest.approx(math.log((0.5 / 5) / (3.5 / 4)))
    assert table[2].woe == pytest.approx(math.log((1 / 5) / (1 / 4)))
    assert all(r.iv >= 0 for r in table)


def test_single_class_gives_no_iv(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (2.0, "b", 1)], "x double, c string, y int")
    fitted = fit_binning(df, ["x", "c"], "y")
    assert all(r.iv is None for r in iv_table(fitted.table).collect())
    assert [tuple(r) for r in woe_transform(df, fitted).select("x_WOE", "c_WOE").collect()] == [(0.0, 0.0)] * 2


def brute(events, totals, trend, min_rows=0.0):
    e_all, n_all = sum(events), sum(totals)
    best, starts = -math.inf, []
    for mask in itertools.product([0, 1], repeat=len(totals) - 1):
        cut = [0, *[i + 1 for i, m in enumerate(mask) if m], len(totals)]
        runs = [(sum(events[a:b]), sum(totals[a:b])) for a, b in zip(cut, cut[1:])]
        rates = [e / n for e, n in runs]
        up = [b >= a for a, b in zip(rates, rates[1:])]
        down = [b <= a for a, b in zip(rates, rates[1:])]
        ok = {
            "asc": all(up), "desc": all(down),
            "peak": any(all(up[:k]) and all(down[k:]) for k in range(len(up) + 1)),
            "valley": any(all(down[:k]) and all(up[k:]) for k in range(len(up) + 1)),
        }
        ok["auto_asc_desc"] = ok["asc"] or ok["desc"]
        ok["auto"] = ok["peak"] or ok["valley"]
        if ok[trend] and all(n >= min_rows for _, n in runs):
            iv = sum(bin_iv(e, n - e, e_all, n_all - e_all) for e, n in runs)
            if iv > best:
                best, starts = iv, cut[:-1]
    return best, starts


bins_strategy = st.lists(
    st.tuples(st.integers(0, 30), st.integers(1, 30)).map(lambda p: (min(p), max(max(p), 1))), min_size=1, max_size=8
)


@settings(max_examples=120, deadline=None)
@given(bins_strategy, st.sampled_from(["asc", "desc", "peak", "valley", "auto_asc_desc", "auto"]), st.sampled_from([0.0, 25.0]))
def test_partition_matches_enumeration(bins, trend, min_rows):
    events, totals = [e for e, _ in bins], [n for _, n in bins]
    if 0 < sum(events) < sum(totals):
        want, _ = brute(events, totals, trend, min_rows)
        got, starts = best_partition(events, totals, sum(events), sum(totals) - sum(events), trend, min_rows)
        assert got == pytest.approx(want) or got == want
        assert bool(starts) == (want > -math.inf)


def test_trends_differ_on_a_valley(spark):
    rows = [(float(x), int(i < 10 * abs(x - 4))) for x in range(9) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y int")
    sizes = {t: fit_binning(df, ["x"], "y", bins=9, trend=t).table.count() for t in ("asc", "desc", "valley", "auto")}
    assert sizes["valley"] == sizes["auto"] == 9 and sizes["asc"] < 9 and sizes["desc"] < 9


def test_merged_rates_are_monotone_and_shares_hold(lines):
    table = fit_binning(lines, NUMERIC, "flag", trend="auto_asc_desc", min_share=0.1).table.where("not is_missing").toPandas()
    for _, group in table.groupby("feature"):
        rates = group.sort_values("bin").event_rate
        assert rates.is_monotonic_increasing or rates.is_monotonic_decreasing
        assert (group.n >= 0.1 * 5867).all()


def manual_woe(frame, fitted, name, missing):
    bins = fitted.numeric[name]
    x = frame[name].to_numpy(dtype=float)
    woe = np.array(bins.woe)[np.searchsorted(np.array(bins.edges), x, "left").clip(max=len(bins.woe) - 1)]
    return np.where(np.isnan(x), bins.missing if missing == "woe" else 0.0, woe)


@pytest.mark.parametrize("missing", ["zero", "woe"])
@pytest.mark.parametrize("arrow_from", [1, 99])
def test_transform_by_both_paths(lines, missing, arrow_from, monkeypatch):
    monkeypatch.setattr(binning, "ARROW_FEATURES", arrow_from)
    fitted = fit_binning(lines, FEATURES, "flag", trend="auto")
    out = woe_transform(lines, fitted, FEATURES, missing=missing)
    assert out.columns == lines.columns + [f"{c}_WOE" for c in FEATURES]
    frame = out.toPandas()
    for c in NUMERIC:
        assert np.array_equal(frame[f"{c}_WOE"].to_numpy(), manual_woe(frame, fitted, c, missing)), c
    replaced = woe_transform(lines, fitted, FEATURES, output="replace", missing=missing)
    assert replaced.columns == lines.columns
    a = replaced.orderBy(*KEY, "hs").select("l_tax", "c_mktsegment").toPandas()
    b = out.orderBy(*KEY, "hs").select("l_tax_WOE", "c_mktsegment_WOE").toPandas()
    assert np.array_equal(a.to_numpy(), b.to_numpy())


@pytest.mark.parametrize("map_size", [0, 64])
def test_unseen_and_missing_categories(spark, map_size, monkeypatch):
    monkeypatch.setattr(binning, "MAP_CATEGORIES", map_size)
    rows = [("a", 1), ("a", 0), ("b", 1), ("b", 1), ("b", 0), ("c", 0), (None, 1), (None, 0), (None, 0)]
    fitted = fit_binning(spark.createDataFrame(rows, "c string, y int"), ["c"], "y")
    woe = {r.category: r.woe for r in fitted.table.collect()}
    new = spark.createDataFrame([("a",), ("new",), (None,), ("c",)], "c string")
    assert {r.c: r.c_WOE for r in woe_transform(new, fitted).collect()} == {"a": woe["a"], "new": 0.0, None: 0.0, "c": woe["c"]}
    assert {r.c: r.c_WOE for r in woe_transform(new, fitted, missing="woe").collect()}[None] == woe[None]


def test_boolean_is_a_category(spark):
    df = spark.createDataFrame([(True, 1), (False, 0), (True, 0), (False, 1), (True, 1)], "f boolean, y int")
    assert {r.category for r in fit_binning(df, ["f"], "y").table.collect()} == {"true", "false"}


def test_save_and_load(spark, lines):
    fitted = fit_binning(lines, FEATURES, "flag", trend="auto")
    path = scratch_path(spark, "bins")
    fitted.save(path)
    loaded = Binning.load(spark, path)
    assert loaded.numeric == fitted.numeric and set(loaded.categorical) == set(fitted.categorical)
    names = [f"{c}_WOE" for c in FEATURES]
    a = woe_transform(lines, fitted, FEATURES).orderBy(*KEY, "hs").select(*names).collect()
    assert a == woe_transform(lines, loaded, FEATURES).orderBy(*KEY, "hs").select(*names).collect()


def test_options_are_checked(lines):
    fitted = fit_binning(lines, ["l_tax"], "flag", class_weight="balanced", exact=False)
    with pytest.raises(ValueError):
        fit_binning(lines, ["l_tax"], "flag", class_weight="other")
    with pytest.raises(ValueError):
        woe_transform(lines, fitted, output="both")
    with pytest.raises(ValueError):
        woe_transform(lines, fitted, ["l_quantity"])


def bin_rows(binning):
    names = ["feature", "bin", "category", "n", "events", "woe", "iv", "lo", "hi"]
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in binning.table.select(*names).collect()), key=str)


def test_fold_binnings_equal_separate_fits(lines):
    """Counted once by fold, a training set's edges, bins and categories are those of its own rows."""
    rows = fold_hash(lines, ["l_orderkey", "l_linenumber", "l_partkey"], 3, 5)
    features = ["l_quantity", "l_tax", "l_extendedprice", "const_f", "o_orderpriority"]
    options = [{"bins": 20}, {"bins": 6, "trend": "auto_asc_desc"}]
    together = fit_binnings(rows, features, "flag", options, "fold", 3)
    assert len(together) == 3 and all(len(t) == 2 for t in together)
    for i, found in enumerate(together):
        train = rows.where(f"fold != {i}")
        for option, binning in zip(options, found):
            alone = fit_binning(train, features, "flag", **option)
            assert bin_rows(binning) == bin_rows(alone)
            assert binning.numeric == alone.numeric and binning.categorical == alone.categorical


def test_fold_edges_against_numpy(spark):
    random = np.random.default_rng(8)
    x, fold = np.round(random.normal(size=500), 2), random.integers(0, 4, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "fold": fold})).repartition(3)
    found = fold_edges(df, ["x"], [3, 7], "fold", 4)
    for t in range(4):
        mine = np.sort(x[fold != t])
        for b in (3, 7):
            ranks = [-(-i * len(mine) // b) for i in range(1, b + 1)]
            assert found[t][b]["x"] == sorted({float(mine[r - 1]) for r in ranks})[:-1] or found[t][b]["x"] == sorted({float(mine[r - 1]) for r in ranks if mine[r - 1] < mine[-1]})


def grouped_by_hand(counts, events, share, rows, totals, max_bins, min_gap):
    """(iv, group of every category) of the best division, by trying all of them."""
    large = [(c, n, e) for (c, n), e in zip(counts, events) if n >= share * rows]
    small = [(c, n, e) for (c, n), e in zip(counts, events) if n < share * rows]
    entries = [((c,), n, e, 1) for c, n, e in large]
    if small:
        entries.append((tuple(c for c, _, _ in small), sum(n for _, n, _ in small), sum(e for _, _, e in small), 0))
    entries.sort(key=lambda r: (r[2] / r[1], r[3], r[0]))
    best = (-1.0, None)
    for cuts in itertools.product([False, True], repeat=len(entries) - 1):
        groups = [[entries[0]]]
        for cut, entry in zip(cuts, entries[1:]):
            if cut:
                groups.append([entry])
            else:
                groups[-1].append(entry)
        sums = [(sum(g[2] for g in group), sum(g[1] for g in group)) for group in groups]
        woe = [bin_woe(e, n - e, *totals) for e, n in sums]
        if len(groups) > max_bins or any(abs(a - b) < min_gap for a, b in zip(woe, woe[1:])):
            continue
        iv = sum(bin_iv(e, n - e, *totals) for e, n in sums)
        if iv > best[0] + 1e-12:
            best = iv, {c: w for group, w in zip(groups, woe) for entry in group for c in entry[0]}
    return best


@pytest.mark.parametrize("max_bins, min_gap, share", [(3, 0.0, 0.04), (4, 0.2, 0.0), (10, 0.1, 0.08)])
def test_merged_categories_are_the_best_division(spark, max_bins, min_gap, share):
    random = np.random.default_rng(11)
    names = [f"c{i}" for i in range(11)]
    c = random.choice(names, 3_000, p=np.arange(1, 12) / 66)
    y = (random.random(3_000) < 0.1 + 0.05 * np.array([int(x[1:]) % 5 for x in c])).astype(int)
    frame = pd.DataFrame({"c": c, "y": y})
    frame.loc[:50, "c"] = None
    df = spark.createDataFrame(frame).repartition(3)
    fitted = fit_binning(df, ["c"], "y", category_share=share, max_bins=max_bins, min_gap=min_gap)
    sums = frame.groupby("c")["y"].agg(["size", "sum"])
    totals = int(y.sum()), int(len(y) - y.sum())
    iv, woe = grouped_by_hand(list(sums["size"].items()), sums["sum"].tolist(), share, len(y), totals, max_bins, min_gap)
    rows = fitted.table.collect()
    assert {r["category"]: pytest.approx(r["woe"], abs=1e-12) for r in rows if r["category"]} == woe
    assert sum(r["iv"] for r in rows if r["category"]) == pytest.approx(iv, abs=1e-12)
    assert sum(r["n"] for r in rows) == 3_000 and len({r["bin"] for r in rows if r["category"]}) <= max_bins
    scored = woe_transform(df, fitted, missing="woe").select("c", "c_WOE").distinct().collect()
    missing = next(r["woe"] for r in rows if r["is_missing"])
    assert {r["c"]: r["c_WOE"] for r in scored} == {**{k: pytest.approx(v, abs=1e-12) for k, v in woe.items()}, None: pytest.approx(missing)}


def test_limits_of_numeric_merges():
    random = np.random.default_rng(12)
    for _ in range(30):
        n = random.integers(5, 60, 8)
        events = [int(random.integers(0, k + 1)) for k in n]
        all_events, others = max(sum(events), 1), max(int(n.sum()) - sum(events), 1)
        for max_bins, gap in ((2, 0.0), (3, 0.4), (None, 0.7)):
            value, starts = best_partition(events, n.tolist(), all_events, others, "asc", 0.0, max_bins, gap)
            best = -math.inf
            for cuts in itertools.product([False, True], repeat=7):
                at = [0, *[i + 1 for i, cut in enumerate(cuts) if cut], 8]
                sums = [(sum(events[a:b]), int(n[a:b].sum())) for a, b in zip(at, at[1:])]
                woe = [bin_woe(e, k - e, all_events, others) for e, k in sums]
                rising = all(a[0] * b[1] <= b[0] * a[1] for a, b in zip(sums, sums[1:]))
                if rising and len(sums) <= (max_bins or 8) and all(abs(a - b) >= gap for a, b in zip(woe, woe[1:])):
                    best = max(best, sum(bin_iv(e, k - e, all_events, others) for e, k in sums))
            assert value == pytest.approx(best) and starts[0] == 0


def test_state_of_two_months_is_the_state_of_both(lines, spark):
    """Bins of A, then B added, equal those of all rows; B alone is read."""
    features = ["l_quantity", "l_tax", "l_extendedprice", "const_f", "o_orderpriority"]
    a, b = lines.where("yr < 1995"), lines.where("yr >= 1995")
    path = scratch_path(spark, "state")
    BinState.of(a, features, "flag").save(path)
    BinState.of(b, features, "flag").save(path, append=True)
    stored = BinState.load(spark, path)
    added = BinState.of(a, features, "flag").add(b, "flag")
    for option in ({"bins": 20}, {"bins": 7, "trend": "auto", "max_bins": 4}, {"bins": 5, "category_share": 0.1, "max_bins": 3}):
        whole = fit_binning(lines, features, "flag", exact=False, **option)
        for state in (stored, added):
            found = state.binning(**option)
            assert bin_rows(found) == bin_rows(whole) and found.numeric == whole.numeric
    with pytest.raises(ValueError, match="different features"):
        stored.merge(BinState.of(a, ["l_tax"], "flag"))
    nothing = BinState.of(lines.limit(0), features, "flag")
    assert bin_rows(nothing.merge(added).binning()) == bin_rows(added.binning())


@pytest.mark.parametrize("held", [1 << 18, 100])
def test_tasks_add_cells_up_over_their_batches(monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD", held)
    random = np.random.default_rng(5)
    frame = pd.DataFrame({"x0": random.integers(0, 40, 5000) / 4, "x1": random.normal(size=5000), "g": random.integers(0, 3, 5000)})
    frame.loc[::7, "x0"] = np.nan
    parts = list(quantiles._counted_cells((frame[low : low + 100] for low in range(0, 5000, 100)), 2, 0, 20, None, 3))
    found = pd.concat(parts).groupby(["g", "f", "cell"])["n"].agg(["sum", "count"])
    for f in range(2):
        known = frame.dropna(subset=[f"x{f}"])
        cell = quantiles.ordered_bits(known[f"x{f}"].to_numpy()) >> 44
        wanted = known.groupby([known["g"], cell]).size()
        mine = found.xs(f, level="f")
        assert dict(mine["sum"]) == dict(wanted)
        assert held == 100 or (mine["count"] == 1).all()
