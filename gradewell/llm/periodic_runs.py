"""Maximal periodic runs of the words of every document.

A run is a stretch of consecutive words with smallest period q, at least twice
as long as q, that neither neighbouring word extends. Runs are proposed by
string synchronising sets: at every scale t = 4, 8, 16, ... a position belongs
to the set if the window of t words with the smallest hash among those that
start within the next t positions starts here or t further on. Membership
depends on the next 2t words alone, so the two periods of a run select the same
positions, and positions with equal contexts 3t to 6t apart propose that distance.

Windows with a period of at most t / 3 take no part in a set. They lie in runs
that are known by then: periods under 12 are found by comparing every word with
the one q further on, larger ones at earlier scales. A run whose first words all
lie in such a region goes over into the next region of the same period (or the
set would have a position in it), so its periods follow from the phases of two
adjacent regions.

Proposals are extended by binary search over prefix hashes and then compared
word by word, so hashes decide only how fast a run is found.

Defined results: null and empty texts have no words and no runs; every input row
gives one row; equal rows give equal rows; columns besides the id and the text
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradewell.columns import col
from gradewell.llm.common import arrow_rows, chunks, mix, raw_texts

DIRECT = 12  # periods below this are found by direct comparison
FIRST_SCALE = DIRECT // 3
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Numbers(dict):
    """word -> its number, in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _stretches(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) of every stretch of consecutive positions."""
    if not len(positions):
        return positions, positions
    cut = np.flatnonzero(np.diff(positions) != 1)
    return positions[np.r_[0, cut + 1]], positions[np.r_[cut, len(positions) - 1]] + 1


class _Texts:
    """Several texts, longest first, one after the other with a mark of its own after each."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.begins = self.ends - self.sizes
        self.words = np.empty(int(self.sizes.sum()) + len(texts), np.int64)
        for k, i in enumerate(self.order):
            self.words[self.begins[k] : self.ends[k]] = texts[i]
        self.words[self.ends] = -1 - np.arange(len(texts))
        n = len(self.words)
        # power[k] = BASE^k; prefix[k] = sum of word * BASE^place over the first k words
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, INVERSE, np.uint64)])
        self.prefix = np.r_[np.uint64(0), np.cumsum(mix(self.words.astype(np.uint64)) * self.power[:n])]

    def reach(self, length: int) -> int:
        """Words of the texts that have at least `length` words."""
        k = int(np.searchsorted(-self.sizes, -length, side="right"))
        return int(self.ends[k - 1]) if k else 0

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1

    def _equal(self, at: np.ndarray, length: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Whether the words of [at, at + length) equal those `by` further on, by hash."""
        p = self.prefix
        return (p[at + length] - p[at]) * self.power[by] == p[at + by + length] - p[at + by]

    def extend(self, first: np.ndarray, last: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the stretch of that period around [first, last], as far as the text goes."""
        text = self.text_of(first)
        low, high = self.begins[text], self.ends[text]
        start, stop = first.copy(), last.copy()
        step = 1 << max(int(self.sizes[0]).bit_length(), 1)
        while step:
            size = np.full(len(start), step)
            fits = start - step >= low
            at = np.where(fits, start - step, start)
            start = np.where(fits & self._equal(at, np.where(fits, size, 0), period), at, start)
            fits = stop + step + period <= high
            start_at = np.where(fits, stop, first)
            stop = np.where(fits & self._equal(start_at, np.where(fits, size, 0), period), stop + step, stop)
            step >>= 1
        return start, stop + period

    def exact(self, start: int, end: int, period: int, at: int) -> tuple[int, int]:
        """The same two bounds, compared word by word."""
        words = self.words
        if np.array_equal(words[start : end - period], words[start + period : end]):
            return start, end
        text = int(self.text_of(np.array([at]))[0])
        low, high = int(self.begins[text]), int(self.ends[text])
        other = np.flatnonzero(words[low : high - period] != words[low + period : high]) + low
        k = int(np.searchsorted(other, at))
        if k < len(other) and other[k] == at:
            return at, at
        return (int(other[k - 1]) + 1 if k else low), (int(other[k]) if k < len(other) else high - period) + period


def _direct(texts: _Texts) -> np.ndarray:
    """Runs of periods under DIRECT: rows (start, end, period)."""
    found = [np.empty((0, 3), np.int64)]
    for q in range(1, DIRECT):
        n = texts.reach(2 * q)
        if n > q:
            start, end = _stretches(np.flatnonzero(texts.words[: n - q] == texts.words[q:n]))
            long = end - start >= q
            found.append(np.column_stack([start[long], end[long] + q, np.full(int(long.sum()), q)]))
    return _smallest(np.concatenate(found))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows with the same bounds the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs) > 1:
        runs = runs[np.r_[True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)]]
    return runs


def _synchronising(texts: _Texts, scale: int, n: int, regions: np.ndarray) -> np.ndarray:
    """The synchronising set of that scale over the first n words."""
    prefix, count = texts.prefix, n + 1 - scale
    ids = mix((prefix[scale : n + 1] - prefix[:count]) * texts.inverse[:count])
    inside = np.zeros(count + 1, np.int64)
    known = regions[(regions[:, 2] * 3 <= scale) & (regions[:, 1] - regions[:, 0] >= scale) & (regions[:, 1] <= n)]
    np.add.at(inside, known[:, 0], 1)
    np.add.at(inside, known[:, 1] - scale + 1, -1)
    ids[np.cumsum(inside[:-1]) > 0] = NONE
    least, step = ids, 1
    while step < scale:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:-1], least[1:])
    m = len(least)
    return np.flatnonzero((least != NONE) & ((ids[:m] == least) | (ids[scale : scale + m] == least)))


def _same_context(texts: _Texts, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of positions with equal contexts 3 to 6 scales apart."""
    context = (texts.prefix[places + 2 * scale] - texts.prefix[places]) * texts.inverse[places]
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    at, by = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    first, k = np.arange(len(places)), 1
    # Contexts in a set have no period of a third of the scale, so at most 18 equal ones begin within 6 scales.
    while True:
        first = first[first + k < len(places)]
        apart = places[first + k] - places[first]
        near = (context[first + k] == context[first]) & (apart < 6 * scale)
        first, apart = first[near], apart[near]
        if not len(first):
            return np.concatenate(at), np.concatenate(by)
        far = apart >= 3 * scale
        at.append(places[first[far]])
        by.append(apart[far])
        k += 1


def _adjacent(texts: _Texts, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) that follow from two regions of one period, the second beginning inside or right after the first."""
    at, by = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    if len(runs) > 1:
        one, two = runs[:-1], runs[1:]
        close = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1]) & (two[:, 1] - one[:, 0] >= 18 * one[:, 2])
        for (s1, e1, q), (s2, e2, _) in zip(one[close].tolist(), two[close].tolist()):
            inner, unit = texts.words[e1 - 2 * q : e1].tobytes(), texts.words[s2 : s2 + q].tobytes()
            place = inner.find(unit)
            while place % 8 and place >= 0:
                place = inner.find(unit, place + 1)
            if place < 0:
                continue
            shift = s2 - (e1 - 2 * q + place // 8)
            periods = np.arange(9 * q + (shift - 9 * q) % q, (e2 - s1) // 2 + 1, q)
            start, end = np.maximum(s1, s2 - periods), np.minimum(e1 + periods, e2)
            fits = end - start >= 2 * periods
            at.append(start[fits])
            by.append(periods[fits])
    return np.concatenate(at), np.concatenate(by)


def _grown(texts: _Texts, at: np.ndarray, by: np.ndarray, chain: int) -> np.ndarray:
    """The runs around the proposals. Proposals of one period at most `chain` apart lie in one stretch."""
    if not len(at):
        return np.empty((0, 3), np.int64)
    order = np.lexsort((at, by))
    at, by = at[order], by[order]
    new = np.r_[True, (np.diff(by) != 0) | (np.diff(at) > chain)]
    first, last, by = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]], by[new]
    start, end = texts.extend(first, last, by)
    rows = {}
    for s, e, q, i in zip(start.tolist(), end.tolist(), by.tolist(), first.tolist()):
        if e - s >= 2 * q and (s, e, q) not in rows:
            s2, e2 = texts.exact(s, e, q, i)
            if e2 - s2 >= 2 * q:
                rows[s2, e2, q] = None
    return np.array(list(rows), np.int64).reshape(-1, 3)


def find_runs(numbered: list[np.ndarray], least: int = 2) -> list[np.ndarray]:
    """Per text its runs of `least` words or more: rows (start, length, period), by start, then period."""
    if not numbered:
        return []
    texts = _Texts(numbered)
    runs = _direct(texts)
    runs = _smallest(np.concatenate([runs, _grown(texts, *_adjacent(texts, runs), 0)]))
    scale = FIRST_SCALE
    while n := texts.reach(6 * scale):
        places = _synchronising(texts, scale, n, runs)
        runs = _smallest(np.concatenate([runs, _grown(texts, *_same_context(texts, places, scale), 2 * scale)]))
        here = runs[(runs[:, 2] >= 3 * scale) & (runs[:, 2] < 6 * scale)]
        runs = _smallest(np.concatenate([runs, _grown(texts, *_adjacent(texts, here), 0)]))
        scale *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    text = texts.text_of(runs[:, 0])
    rows = np.column_stack([runs[:, 0] - texts.begins[text], runs[:, 1] - runs[:, 0], runs[:, 2]])
    order = np.lexsort((rows[:, 2], rows[:, 0], text))
    rows, cut = rows[order], np.searchsorted(text[order], np.arange(len(numbered) + 1))
    found: list = [None] * len(numbered)
    for k, i in enumerate(texts.order):
        found[i] = rows[cut[k] : cut[k + 1]]
    return found


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by a space, without those that a run contains after its first period."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)


SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: the runs of at least `least` words, by
    start, then period, and the text with every run cut to its first period."""

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            texts = raw_texts(batch.column(1))
            counts, runs, collapsed = [], [], []
            for a, b in chunks(texts):
                number = _Numbers()
                words = [raw.split() for raw in texts[a:b]]
                numbered = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
                for w, found in zip(words, find_runs(numbered, least)):
                    counts.append(len(w))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found.tolist()])
                    collapsed.append(collapse(w, found).decode())
            return {"doc_id": batch.column(0), "n_words": counts, "runs": runs, "collapsed": collapsed}

        return rows

    source = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return arrow_rows(source, task, SCHEMA)
