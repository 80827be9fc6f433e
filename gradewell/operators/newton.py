"""Logistic regressions of many settings and training sets from the same scans.

The objective is the one of the built-in regression: mean log loss, plus
reg * (elastic * sum |b s| + (1 - elastic) / 2 * sum (b s)^2) over the slopes b, with
s the sample standard deviation of each feature. All settings and folds take
their steps together: in every iteration tasks add up one gradient and one matrix of
second derivatives per setting and training set, for rows outside the set's fold; the
step of each is then solved from numbers of the size of features x features. So the
scans are as many as the slowest setting needs, whatever the number of settings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import binary, col
from gradewell.operators.linear import LinearScore

# Sweeps over the coordinates of one step with an absolute penalty.
SWEEPS = 1_000


def _step(gradient: np.ndarray, second: np.ndarray, at: np.ndarray, flat: np.ndarray, square: np.ndarray) -> np.ndarray:
    """The minimum of the quadratic model around `at` plus flat * |b| + square / 2 * b^2."""
    second = second + np.diag(square + 1e-12)
    gradient = gradient + square * at
    if not flat.any():
        return at - np.linalg.solve(second, gradient)
    new = at.copy()
    slope = gradient.copy()  # of the quadratic model at `new`
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(new)):
            curve = second[j, j]
            goal = new[j] - slope[j] / curve
            goal = np.sign(goal) * max(abs(goal) - flat[j] / curve, 0.0)
            if goal != new[j]:
                change = goal - new[j]
                slope += second[:, j] * change
                new[j] = goal
                most = max(most, abs(change))
        if most < 1e-12:
            break
    return new


def logistic_fits(df: DataFrame, features: Sequence[str], label: str, points: Sequence[tuple[float, float]],
                  fold_col: str | None = None, folds: int = 0, tol: float = 1e-9, max_iter: int = 50) -> list[list[LinearScore]]:
    """[training set][point]: the fitted scores for every (reg, elastic). With folds, set i has all rows but those of fold i.
    Rows without a label are left out; a null feature is an error."""
    features, sets, k = list(features), max(folds, 1), len(points)
    names = [f"x{i}" for i in range(len(features))]
    fold = col(fold_col).cast("int") if fold_col else F.lit(-1)
    narrow = df.where(col(label).isNotNull()).select(
        *[col(c).cast("double").alias(x) for c, x in zip(features, names)], binary(df, label).cast("double").alias("y"), fold.alias("g")
    ).persist()
    try:
        return _fitted(narrow, features, names, points, sets, k, tol, max_iter)
    finally:
        narrow.unpersist()


def _fitted(narrow: DataFrame, features: list[str], names: list[str], points: Sequence[tuple[float, float]], sets: int, k: int,
            tol: float, max_iter: int) -> list[list[LinearScore]]:
    d = len(names)
    moments = narrow.groupBy("g").agg(
        F.count("*").alias("n"), F.sum("y").alias("y"), *[F.avg(x).alias(f"m_{x}") for x in names], *[F.var_pop(x).alias(f"v_{x}") for x in names]
    ).collect()  # one row per fold
    n, events, mean, spread = np.zeros(sets), np.zeros(sets), np.zeros((sets, d)), np.ones((sets, d))
    for t in range(sets):
        own = [r for r in moments if r["g"] != t]
        n[t], events[t] = sum(r["n"] for r in own), sum(r["y"] for r in own)
        if not n[t]:
            raise ValueError("a training set has no rows")
        weight = np.array([r["n"] for r in own]) / n[t]
        means, variances = (np.array([[r[f"{kind}_{x}"] or 0.0 for x in names] for r in own]) for kind in "mv")
        mean[t] = weight @ means
        variance = (weight @ (variances + (means - mean[t]) ** 2)) * n[t] / max(n[t] - 1, 1)
        spread[t] = np.sqrt(np.where(variance > 1e-28 * mean[t] ** 2, variance, 0.0))
    varies = spread > 0
    scale = np.where(varies, spread, 1.0)
    share = np.clip(events / n, 1e-9, 1 - 1e-9)
    # Standardised slopes, then the intercept, of every set and point.
    at = np.zeros((sets, k, d + 1))
    at[:, :, d] = np.log(share / (1 - share))[:, None]
    flat, square = (np.array([[v] * d + [0.0] for v in part]) for part in zip(*[(reg * elastic, reg * (1 - elastic)) for reg, elastic in points]))

    def sums(state: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wanted = np.argwhere(active)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, grad, second = np.zeros(len(wanted)), np.zeros((len(wanted), d + 1)), np.zeros((len(wanted), d + 1, d + 1))
            for batch in batches:
                raw, y, g = batch[names].to_numpy(dtype="float64"), batch["y"].to_numpy(), batch["g"].to_numpy()
                if np.isnan(raw).any():
                    raise ValueError("a feature is null")
                for t in sorted(set(wanted[:, 0].tolist())):
                    mine = g != t
                    x = np.column_stack([np.where(varies[t], (raw[mine] - mean[t]) / scale[t], 0.0), np.ones(int(mine.sum()))])
                    own = y[mine]
                    for i in np.flatnonzero(wanted[:, 0] == t):
                        z = x @ state[t, wanted[i, 1]]
                        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                        loss[i] += (np.logaddexp(0.0, z) - own * z).sum()
                        grad[i] += x.T @ (p - own)
                        second[i] += (x * (p * (1 - p))[:, None]).T @ x
            flat_rows = np.concatenate([loss[:, None], grad, second.reshape(len(wanted), -1)], axis=1)
            yield pd.DataFrame({"i": np.arange(flat_rows.size), "v": flat_rows.ravel()})

        total = narrow.mapInPandas(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat_sums = np.zeros(len(wanted) * (1 + (d + 1) + (d + 1) ** 2))
        for r in total:
            flat_sums[r["i"]] = r["v"]
        table = flat_sums.reshape(len(wanted), -1) / n[wanted[:, 0], None]
        return table[:, 0], table[:, 1 : d + 2], table[:, d + 2 :].reshape(-1, d + 1, d + 1)

    def penalty(j: int, b: np.ndarray) -> float:
        return float((flat[j] * np.abs(b) + square[j] / 2.0 * b**2).sum())

    active = np.ones((sets, k), bool)
    accepted, value, step = at.copy(), np.full((sets, k), np.inf), np.zeros_like(at)
    for _ in range(max_iter):
        loss, grad, second = sums(at, active)
        for i, (t, j) in enumerate(np.argwhere(active)):
            now = loss[i] + penalty(j, at[t, j])
            if now > value[t, j] + 1e-12 and np.abs(step[t, j]).max() > tol:
                step[t, j] /= 2.0  # too far: half the way
                at[t, j] = accepted[t, j] + step[t, j]
                continue
            accepted[t, j], value[t, j] = at[t, j], now
            new = _step(grad[i], second[i], at[t, j], flat[j], square[j])
            new[:d][~varies[t]] = 0.0
            step[t, j] = new - at[t, j]
            at[t, j] = new
            if np.abs(step[t, j]).max() < tol:
                accepted[t, j], active[t, j] = new, False
        if not active.any():
            break
    found = []
    for t in range(sets):
        slopes = accepted[t, :, :d] / scale[t]
        found.append([
            LinearScore(inputCols=features, weights=[float(v) for v in b], bias=float(accepted[t, j, d] - b @ mean[t])) for j, b in enumerate(slopes)
        ])
    return found
