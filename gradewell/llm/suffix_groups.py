"""Suffix array of an integer string by linear grouping.

First suffixes are grouped by their Lyndon prefix: groups are taken in
descending order, and for every suffix of a group the nearest suffix before it
that lies in a lower group is found along pointers to previous smaller ones.
Suffixes so pointed at move up within their group, those pointed at most often
farthest. Then the order inside the groups is written out from the smallest
suffix on: a suffix, once placed, places those before it along the same
pointers. No string is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `text` (non-negative integers) in lexicographic order."""
    n = len(text) + 1
    if n == 1:
        return np.empty(0, np.int64)
    symbols = np.r_[np.asarray(text, np.int64) + 1, 0]  # the end is smaller than all
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = symbols[by_symbol]
    begins = np.r_[True, ordered[1:] != ordered[:-1]]
    first_of = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    order: list[int] = by_symbol.tolist()
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    place = place.tolist()
    group = np.empty(n, np.int64)  # of a suffix: where its group begins
    group[by_symbol] = first_of
    group = group.tolist()
    size = [0] * n  # of a group, at its beginning
    for start, count in zip(*(x.tolist() for x in np.unique(first_of, return_counts=True))):
        size[start] = count
    before = [-1] * n

    end = n
    while end > 0:
        low = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for s in sorted(order[low:end]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for p, times in pointed.items():
                by_count.setdefault(times, []).append(p)
            for times in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[times]:
                    g = group[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    to, at = g + size[g] - m, place[p]
                    if to != at:
                        other = order[to]
                        order[to], order[at] = p, other
                        place[p], place[other] = to, at
                for g, m in moved.items():
                    rest = size[g] - m
                    if rest:
                        size[g], new = rest, g + rest
                        size[new] = m
                        for k in range(new, new + m):
                            group[order[k]] = new
        end = low

    front = list(range(n))
    result = [-1] * n
    placed = [False] * n
    result[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            result[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = before[s]
    return np.array(result[1:], np.int64)


def repeated_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For every start (each with `length` symbols after it): does another start have the same `length` symbols?

    In suffix order equal prefixes are neighbours, so each start is compared with the next alone.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.empty(max(len(order) - 1, 0), bool)
    for low in range(0, len(same), 65_536):
        high = min(low + 65_536, len(same))
        same[low:high] = (windows[order[low:high]] == windows[order[low + 1 : high + 1]]).all(1)
    found = np.zeros(len(text), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return found[starts]
