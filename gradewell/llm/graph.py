"""Groups of linked items: comparing the members of buckets, and components of the links.

Neither function holds a whole bucket or component in one task. Members of a
large bucket are dealt into tiles by their hash, and every pair of tiles meets
in a task of its own, so each pair of members meets somewhere. A task reports
only links that join what it has not yet joined: as many as members at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import schema_of
from gradewell.workspace import staged

# Members of a bucket that are compared in one task.
TILE = 1_024


class Forest:
    """Which of n rows are joined so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.root[max(i, j)] = min(i, j)
        return True

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where i and j have not been joined."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                break
            self.root = up
        return self.root[i] != self.root[j]


def bucket_links(
    rows: DataFrame, key: list[str], member: str, accept: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    schema: str, tile: int = TILE,
) -> DataFrame:
    """(a, b): accepted links that span, within every bucket, what its accepted pairs join.

    rows holds each member once per bucket, with the columns of `schema`, the
    member's identifier (a long, column `member`) among them. accept(table)
    gives the function (i, j) -> mask over pairs of its rows.
    """
    hashed = F.xxhash64(*key)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(col("__n") > 1)
    tiled = rows.join(sizes, key).withColumn("__tiles", F.ceil(col("__n") / tile))
    own = F.pmod(F.xxhash64(F.lit("tile"), col(member)), col("__tiles"))
    tiled = tiled.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), col("__tiles") - 1)))
    group = F.xxhash64(hashed, F.least("__own", "__other"), F.greatest("__own", "__other"))
    names = [f.name for f in schema_of(schema)]
    dealt = tiled.select(group.alias("__group"), *names).repartition("__group").sortWithinPartitions("__group", member)
    at = names.index(member) + 1

    def links(table: pa.Table) -> pa.RecordBatch:
        """All groups of one table, side by side: every row with the s-th after it, for s = 1, 2, ..."""
        group = table.column(0).to_numpy()
        ids = table.column(at).to_numpy()
        change = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
        end = np.repeat(change, np.diff(np.r_[0, change]))
        ok, forest = accept(table), Forest(len(group))
        a, b = [], []
        i, step = np.arange(len(group)), 1
        while True:
            i = i[i + step < end[i]]
            if not len(i):
                break
            j = i + step
            new = forest.apart(i, j)
            x, y = i[new], j[new]
            good = ok(x, y)
            for p, q in zip(x[good].tolist(), y[good].tolist()):
                if forest.join(p, q):
                    a.append(ids[p])
                    b.append(ids[q])
            step += 1
        return pa.RecordBatch.from_pydict({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if cut or (held and held[-1].column(0)[-1].as_py() != group[-1]):
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _stars(pairs: DataFrame, centre: str, leaf: str) -> DataFrame:
    """Per centre the smallest of its leaves and itself, joined to each leaf.
    The join splits the leaves of a large centre; the minimum is taken before the shuffle."""
    least = pairs.groupBy(centre).agg(F.min(leaf).alias("m")).select(centre, F.least("m", centre).alias("m"))
    return pairs.join(least, centre)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): every node of the links (a, b) with the smallest it is joined to.

    Alternates large-star and small-star steps, each written to the shared
    folder, until one changes nothing; the number of rounds grows with the
    logarithm of the largest component.
    """
    edges = staged(links.where(col("a") != col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(col("v").alias("u"), col("u").alias("v")))
        large = _stars(both, "u", "v").where(col("v") > col("u")).select(col("v").alias("u"), col("m").alias("v")).distinct()
        small = _stars(large, "u", "v")
        small = small.select(col("v").alias("u"), col("m").alias("v")).unionByName(small.select("u", col("m").alias("v")))
        edges = staged(small.where(col("u") != col("v")).distinct(), name)
    nodes = edges.select(col("u").alias("node"), col("v").alias("component"))
    return nodes.unionByName(edges.select(col("v").alias("node"), col("v").alias("component")).distinct())
