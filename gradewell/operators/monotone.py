"""Merging adjacent bins so that the event rate follows a trend and the
information value is as large as the trend allows.

The choice is solved exactly per feature by dynamic programming over (last
bin's start, last bin's stop). A feature has a bounded number of pre-bins, so
a group of this job holds a few dozen rows whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

from gradewell.functions.weights import bin_iv, bin_woe

# Each trend is a list of directions, taken in turn: +1 rising, -1 falling event rate.
DIRECTIONS = {"asc": (1,), "desc": (-1,), "peak": (1, -1), "valley": (-1, 1)}
CHOICES = {"auto_asc_desc": ("asc", "desc"), "auto": ("asc", "desc", "peak", "valley")}


def best_partition(events: Sequence[int], totals: Sequence[int], all_events: int, all_non_events: int,
                   trend: str = "auto_asc_desc", min_rows: float = 0.0, max_bins: int | None = None,
                   min_gap: float = 0.0) -> tuple[float, list[int]]:
    """(iv, starts) of the best division of the bins into runs, or (-inf, [])
    when no division meets the trend, the least rows of a run, the largest number
    of runs and the least distance of the WoE of neighbouring ones."""
    options = [
        _solve(events, totals, all_events, all_non_events, DIRECTIONS[t], min_rows, max_bins, min_gap) for t in CHOICES.get(trend, (trend,))
    ]
    return max(options, key=lambda o: o[0])


def _solve(events, totals, all_events, all_non_events, directions, min_rows, max_bins, min_gap):
    size = len(totals)
    e = [0, *pd.Series(events, dtype="int64").cumsum()]
    n = [0, *pd.Series(totals, dtype="int64").cumsum()]

    def segment(i, j):
        bad, rows = int(e[j] - e[i]), int(n[j] - n[i])
        return bad, rows

    def woe(i, j):
        bad, rows = segment(i, j)
        return bin_woe(bad, rows - bad, all_events, all_non_events)

    # best[(phase, i, j, runs)]: the largest iv of bins 0..j-1 whose last run is i..j-1, and the run before it.
    # The number of runs is only told apart (else 0) where it is limited.
    best: dict[tuple[int, int, int, int], tuple[float, tuple[int, int, int, int] | None]] = {}
    counts = range(1, max_bins + 1) if max_bins else (0,)
    for j in range(1, size + 1):
        for i in range(j):
            bad, rows = segment(i, j)
            if rows < min_rows:
                continue
            gain = bin_iv(bad, rows - bad, all_events, all_non_events)
            if i == 0:
                best[0, i, j, counts[0]] = (gain, None)
                continue
            for phase, sign in enumerate(directions):
                options: dict[int, list] = {}
                for h in range(i):
                    before_bad, before_rows = segment(h, i)
                    # cross-multiplied rates: exact in whole numbers
                    if sign * (bad * before_rows - before_bad * rows) < 0:
                        continue
                    if min_gap and abs(woe(i, j) - woe(h, i)) < min_gap:
                        continue
                    for earlier in (phase, phase - 1):
                        for c in counts:
                            if (earlier, h, i, c) in best and (not max_bins or c < max_bins):
                                options.setdefault(c + 1 if max_bins else 0, []).append((best[earlier, h, i, c][0], (earlier, h, i, c)))
                for c, found in options.items():
                    value, link = max(found, key=lambda o: (o[0], [-k for k in o[1]]))
                    best[phase, i, j, c] = (value + gain, link)
    ends = [(value, state) for state, (value, _) in best.items() if state[2] == size]
    if not ends:
        return -math.inf, []
    value, state = max(ends, key=lambda o: (o[0], [-k for k in o[1]]))
    starts = []
    while state is not None:
        starts.append(state[1])
        state = best[state][1]
    return value, starts[::-1]


def woe_monotone(counts: DataFrame, all_events: int, all_non_events: int, trend: str = "auto_asc_desc",
                 min_share: float = 0.0, max_bins: int | None = None, min_gap: float = 0.0) -> DataFrame:
    """(feature, bin, merged): which merged bin each numeric pre-bin belongs to.

    `counts` holds (feature, bin, n, events) per pre-bin, without the missing
    bin. Falls back to one bin when no division meets the constraints of best_partition.
    """
    rows = all_events + all_non_events

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        _, starts = best_partition(
            group["events"].tolist(), group["n"].tolist(), all_events, all_non_events, trend, min_share * rows, max_bins, min_gap
        )
        position = pd.Series(range(len(group)), index=group.index)
        merged = sum(((position >= s).astype("int32") for s in starts[1:]), start=position * 0)
        return pd.DataFrame({"feature": group["feature"], "bin": group["bin"], "merged": merged})

    return counts.select("feature", "bin", "n", "events").groupBy("feature").applyInPandas(
        solve, "feature string, bin int, merged int"
    )
