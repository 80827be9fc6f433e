"""Approximate nearest neighbours by inner product with a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by its
`LIST` nearest pivots in order of nearness, and posted under each of them with
the place the pivot has in its order. A query goes through the postings of its
own nearest pivots, ranks what it meets by the footrule distance of the two
orders (a pivot missing from an order counts as at place LIST), and reranks the
nearest `SHARE` of each shard, `LEAST` at least, by the exact inner product in
double precision.

So that orders speak about inner products and not angles, vectors get one more
component, sqrt(M^2 - |x|^2) with M the largest length (queries get 0): then all
are equally long, and the largest inner product is the smallest angle.

Queries are searched in blocks of bounded size, one pass over the index each, and
what a block finds is written to the shared folder before the next is collected; a
task keeps the best `k` of each query over its shard. Copies of a vector in a
shard are one entry with its k + 1 smallest ids, which is all that can be asked for.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows without an id; rows equal in id and vector
are one; vectors only meet vectors of their own length; ties go to the smaller
id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import schema_of
from gradewell.workspace import scratch_path, staged

PIVOTS = 256
LIST = 64
SHARE = 0.15
LEAST = 1_000
QUERY_BLOCK = 4_096
QUERIES_AT_ONCE = 128
SHARD_ROWS = 16_384


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, length: float, query: bool, size: int) -> np.ndarray:
    """The nearest `size` pivots of every vector, nearest first."""
    last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(length**2 - (vectors**2).sum(1), 0))
    near = np.c_[vectors, last] @ pivots.T
    size = min(size, len(pivots))
    some = np.argpartition(-near, size - 1, axis=1)[:, :size]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


class Best:
    """The k best (score, id) of every query of a block so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score[query], score], np.r_[self.ids[query], ids]
        first = np.lexsort((ids, -score))[: self.k]
        self.score[query], self.ids[query] = score[first], ids[first]


def search_shard(
    best: Best, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    query_orders: np.ndarray, n_pivots: int, share: float, least: int,
) -> None:
    """Add to `best` what the block's queries find in one shard."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors, orders = ids[by_id], vectors[by_id], orders[by_id]
    packed = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, entry, of = np.unique(packed, return_index=True, return_inverse=True)
    by_entry = np.argsort(of, kind="stable")  # ids ascending within an entry
    begin = np.searchsorted(of[by_entry], np.arange(len(entry) + 1))
    vectors, orders = vectors[entry], orders[entry]
    n, size = len(entry), orders.shape[1]
    # Inverted files: under each pivot the entries that list it and the place it has there.
    flat = orders.ravel()
    sort = np.argsort(flat, kind="stable")
    posted, place = (sort // size).astype(np.int64), (sort % size).astype(np.int16)
    file = np.searchsorted(flat[sort], np.arange(n_pivots + 1))
    wanted = min(n, max(least, int(np.ceil(share * n))))
    for low in range(0, len(queries), QUERIES_AT_ONCE):
        block = range(low, min(low + QUERIES_AT_ONCE, len(queries)))
        # The footrule distance less that of orders without a common pivot.
        footrule = np.zeros((len(block), n), np.int16)
        for row, q in enumerate(block):
            for at, pivot in enumerate(query_orders[q]):
                part = slice(file[pivot], file[pivot + 1])
                footrule[row, posted[part]] += np.abs(place[part] - at) - (size - at) - (size - place[part])
        if wanted < n:
            nearest = np.argpartition(footrule, wanted - 1, axis=1)[:, :wanted]
        for row, q in enumerate(block):
            candidates = nearest[row] if wanted < n else np.arange(n)
            score = (vectors[candidates] * queries[q]).sum(1)
            enough = min(len(score), best.k + 1)
            floor = np.partition(score, len(score) - enough)[len(score) - enough]
            keep = score >= max(floor, best.score[q, -1])
            for c, s in zip(candidates[keep], score[keep]):
                own = ids[by_entry[begin[c] : begin[c + 1]]]
                own = np.unique(own[: best.k + 1 + int((own == query_ids[q]).sum())])
                own = own[own != query_ids[q]][: best.k]
                best.add(q, np.full(len(own), s), own)


def nearest(
    df: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None,
    n_pivots: int = PIVOTS, size: int = LIST, share: float = SHARE, least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which `query`
    (a condition on column vec_id) holds, among all other rows."""
    spark = df.sparkSession
    query = F.lit(True) if query is None else query
    vectors = df.select(col(id_col).cast("bigint").alias("vec_id"), col(vector_col).cast("array<double>").alias("vector"))
    vectors = vectors.where(col("vec_id").isNotNull() & usable(col("vector")))
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    schema = "query_id bigint, query_vector bigint, vec_id bigint, score double"
    path, written = scratch_path(spark, "nearest"), 0
    lengths = vectors.groupBy(F.size("vector").alias("dim")).agg(F.max(squared).alias("longest")).collect()  # one row per length of vector
    for dim, longest in ((r["dim"], r["longest"]) for r in lengths):
        own = vectors.where(F.size("vector") == dim)
        length = float(np.sqrt(longest))
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(n_pivots).toArrow()  # the bounded sample
        table = _matrix(sample.column("vector").combine_chunks(), dim)
        pivots = np.c_[table, np.sqrt(np.maximum(length**2 - (table**2).sum(1), 0))]
        pivots = np.unique(pivots, axis=0)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)

        def order(batches: Iterator[pa.RecordBatch], pivots=pivots, dim=dim, length=length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    orders = pivot_orders(_matrix(batch.column(1), dim), pivots, length, False, size).astype(np.int16)
                    rows = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * orders.shape[1], pa.array(orders.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, rows], ["vec_id", "vector", "pivots"])

        index = staged(own.mapInArrow(order, schema_of("vec_id bigint, vector array<double>, pivots array<smallint>")), "index")
        asked = index.where(query).select("vec_id", "vector").distinct()
        blocks = int(-(-asked.count() // QUERY_BLOCK))
        asked = staged(asked.withColumn("block", F.expr(f"pmod(xxhash64(vec_id, vector), {max(1, blocks)})")), "asked")
        for b in range(blocks):
            block = asked.where(col("block") == b).orderBy("vec_id", "vector").toArrow()  # about QUERY_BLOCK rows
            query_ids, queries = block.column("vec_id").to_numpy(), _matrix(block.column("vector").combine_chunks(), dim)
            query_orders = pivot_orders(queries, pivots, length, True, size).astype(np.int16)

            def search(
                batches: Iterator[pa.RecordBatch], query_ids=query_ids, queries=queries, query_orders=query_orders, dim=dim, n=len(pivots)
            ) -> Iterator[pa.RecordBatch]:
                best, held, rows = Best(len(queries), k), [], 0

                def flush() -> None:
                    shard = pa.Table.from_batches(held).combine_chunks()
                    orders = np.asarray(shard.column(2).combine_chunks().flatten()).reshape(shard.num_rows, -1)
                    search_shard(
                        best, shard.column(0).to_numpy(), _matrix(shard.column(1).combine_chunks(), dim), orders, query_ids, queries,
                        query_orders, n, share, least,
                    )

                for batch in batches:
                    if batch.num_rows:
                        held.append(batch)
                        rows += batch.num_rows
                    if rows >= SHARD_ROWS:
                        flush()
                        held, rows = [], 0
                if held:
                    flush()
                q, c = np.nonzero(best.score > -np.inf)
                yield pa.RecordBatch.from_pydict({
                    "query_id": query_ids[q], "query_vector": q.astype(np.int64), "vec_id": best.ids[q, c], "score": best.score[q, c],
                })

            found = index.mapInArrow(search, schema)
            found.withColumn("query_vector", col("query_vector") + written * (1 << 32)).write.mode("append").parquet(path)
            written += 1
    result = spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
    # The same id may come from several shards, as copies of one row.
    window = Window.partitionBy("query_id", "query_vector").orderBy(F.desc("score"), "vec_id")
    ranked = result.distinct().withColumn("rank", F.row_number().over(window)).where(col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
