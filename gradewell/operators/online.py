"""Passive-aggressive classifier (PA-II, squared hinge) by iterative parameter mixing.

Rows are dealt to a number of partitions by key hash and ordered by it. In
every epoch each partition runs through its rows from the shared weights; the
results are averaged, weighted by rows. The outcome depends on the number of
partitions, which is an argument or follows from the number of rows, and on
nothing else about the layout.

Rows that are complete copies are grouped before they are dealt. Updating m
times on one row has a closed form: with q = (1/2C) / (|x|^2 + 1/2C) the loss
shrinks by q each time, so the steps form a geometric series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import binary, col
from gradewell.functions.hashing import row_hash
from gradewell.operators.linear import LinearScore
from gradewell.workspace import pinned


# Rows of one partition's run, about half a minute for twenty candidates.
PARTITION_ROWS = 1_000_000


def run_rows(weights: np.ndarray, total: np.ndarray, x: np.ndarray, y: np.ndarray, copies: np.ndarray,
             inverse: np.ndarray) -> None:
    """One run over rows x (last column 1) with labels y in {-1, 1}, in place.

    `weights` has one row per candidate C, `inverse[class]` is 1/2C per
    candidate; `total` adds up the weights after every single update.

    Rows go in blocks: the products of a block's rows with each other and with the
    weights before it are two matrix products, and within the block an update only
    needs the step sizes of the rows before. The updates are those of one row
    after the other.
    """
    steps = _few_steps if len(weights) <= FEW else _many_steps
    sign, m = y[:, None], copies[:, None].astype(float)
    signed = x * sign
    slack = inverse[(y > 0).astype(np.int64)]
    room = np.einsum("ij,ij->i", x, x)[:, None] + slack
    rate, later = 1.0 / room, np.ones_like(room)
    if (copies > 1).any():
        q = slack / room
        series = np.where(m == 1, 1.0, (1.0 - q**m) / (1.0 - q))
        # what the row's own updates add to the sum of weights, per unit of the last one
        rate, later = series / room, np.where(m == 1, 1.0, (m - q * series) / (1.0 - q)) / series
    until = np.cumsum(copies)
    for low in range(0, len(x), BLOCK):
        high = min(low + BLOCK, len(x))
        rows = signed[low:high]
        moved = steps(1.0 - rows @ weights.T, rows @ rows.T, rate[low:high])
        after = (until[high - 1] - until[low:high])[:, None]
        total += (until[high - 1] - until[low] + copies[low]) * weights + (moved * (after + later[low:high])).T @ rows
        weights += moved.T @ rows


# Rows of a block: more make longer sums per row, fewer more matrix products.
BLOCK = 32
# Up to this many candidates plain numbers are faster than small arrays.
FEW = 4


def _few_steps(gap: np.ndarray, cross: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Step sizes of a block, (rows, candidates): the gap to margin 1 before the block, less what earlier steps closed, times the rate."""
    products, out = cross.tolist(), np.empty_like(gap)
    for k in range(gap.shape[1]):
        sizes: list[float] = []
        for margin, speed, row in zip(gap[:, k].tolist(), rate[:, k].tolist(), products):
            left = margin - sum(map(mul, sizes, row))
            sizes.append(left * speed if left > 0.0 else 0.0)
        out[:, k] = sizes
    return out


def _many_steps(gap: np.ndarray, cross: np.ndarray, rate: np.ndarray) -> np.ndarray:
    out, left = np.empty_like(gap), np.empty(gap.shape[1])
    for r in range(len(gap)):
        np.subtract(gap[r], cross[r, :r] @ out[:r], out=left)
        np.multiply(np.maximum(left, 0.0, out=left), rate[r], out=out[r])
    return out


def pa_fit_many(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], costs: Sequence[float],
                partitions: int | None = None, max_iter: int = 10, tol: float = 1e-3, balanced: bool = True,
                average: bool = True, seed: object = 0) -> list[LinearScore]:
    """One fitted score per C in `costs`, all trained in the same passes.

    Features are standardised inside and must not be null. average=True shares
    the mean of a partition's iterates, average=False its last iterate. A
    partition is one task's sequential run; by default there is one for every
    PARTITION_ROWS labelled rows, so the tasks grow in number and not in length.
    """
    features = list(features)
    known = df.where(col(label).isNotNull())
    event = binary(df, label) == 1
    stats = known.agg(
        F.count("*"), F.count_if(event),
        *[f(col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)],
    ).first()
    rows, events = stats[0], stats[1]
    partitions = partitions or max(1, -(-rows // PARTITION_ROWS))
    means = np.array([float(v or 0.0) for v in stats[2::2]])
    spreads = np.array([float(v) if v else 1.0 for v in stats[3::2]])
    share = [rows / (2.0 * max(rows - events, 1)), rows / (2.0 * max(events, 1))] if balanced else [1.0, 1.0]
    inverse = np.array([[1.0 / (2.0 * c * s) for c in costs] for s in share])
    names = [f"x{i}" for i in range(len(features))]
    scaled = [
        ((col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(x)
        for c, x, m, s in zip(features, names, means, spreads)
    ]
    dealt = pinned(
        known.select(row_hash(key, seed).alias("h"), *scaled, F.when(event, 1.0).otherwise(-1.0).alias("y"))
        .groupBy("h", *names, "y").agg(F.count("*").alias("m"))
        .repartition(partitions, "h")
        .sortWithinPartitions("h", *names, "y")
        .select(*names, "y", "m")
    )
    shape = (len(costs), len(features) + 1)

    def epoch(start: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights, total, n = start.copy(), np.zeros(shape), 0
            for batch in batches:
                x = np.column_stack([batch[names].to_numpy(dtype="float64"), np.ones(len(batch))])
                if np.isnan(x).any():
                    raise ValueError("a feature is null")
                copies = batch["m"].to_numpy()
                run_rows(weights, total, x, batch["y"].to_numpy(), copies, inverse)
                n += int(copies.sum())
            share = total if average else weights * n
            yield pd.DataFrame({"i": np.arange(share.size), "v": share.ravel(), "n": n})

        mixed = dealt.mapInPandas(run, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        result = np.zeros(start.size)
        for r in mixed.collect():  # one row per weight
            result[r["i"]] = r["v"] / max(r["n"], 1)
        return result.reshape(shape)

    weights = np.zeros(shape)
    for _ in range(max_iter):
        after = epoch(weights)
        moved = float(np.abs(after - weights).max())
        weights = after
        if moved < tol:
            break
    models = []
    for w in weights:
        slope = w[:-1] / spreads
        models.append(LinearScore(
            inputCols=features, weights=[float(v) for v in slope], bias=float(w[-1] - slope @ means)
        ))
    return models


def pa_fit(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], cost: float = 1.0, **options) -> LinearScore:
    return pa_fit_many(df, features, label, key, [cost], **options)[0]
