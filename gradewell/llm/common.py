"""Text and Arrow helpers shared by the training-data operators.

Words are runs of bytes outside space and tab to carriage return, after A-Z
have been lower-cased; every other letter keeps its case. A null text counts
as empty. Functions below that name "tasks" run inside Spark tasks on one Arrow
batch at a time, so memory follows the batch, not the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Entries of a per-task look-up before it is emptied: it only saves work, results do not depend on it.
CACHE_WORDS = 250_000
# Rows that a task turns into Python objects together.
ROWS_AT_ONCE = 512


class Cache(dict):
    """word -> value, made by `make` on first use, emptied when it grows too large."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self.make(word)
        if len(word) <= 64:
            self[word] = value
        return value


def hash64(value: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(value, seed)


def split_words(raw: bytes) -> list[bytes]:
    return raw.translate(LOWER).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text in an Arrow column, empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) of texts that hold about `limit` bytes, so that arrays over their words stay small."""
    start = size = 0
    for i, raw in enumerate(texts):
        size += len(raw)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, where each text begins; one more entry at the end)."""
    starts, parts = [0], []
    for raw in texts:
        words = split_words(raw)
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        starts.append(starts[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(starts, np.int64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for every i that has as many words after it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[k : k + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """n odd factors: x -> x * factor gives as many orders of the same hashes."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# Bytes of rows that Spark hands to a task's Python process together.
BATCH_BYTES = 8_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, with Spark's Arrow batches of this session held to BATCH_BYTES: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")
    return df


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ROWS_AT_ONCE."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def schema_of(text: str) -> StructType:
    return _parse_datatype_string(text)


def arrow_rows(df: DataFrame, task: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """One output batch (a dict of columns) for every few hundred rows of df.

    `task()` is called once in every task and returns the function for its
    batches, so it may keep look-ups between them.
    """
    spark_schema = schema_of(schema)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = task()
        for batch in small(batches):
            if (columns := work(batch)) is not None:
                yield pa.RecordBatch.from_pydict(columns, schema=arrow_schema)

    return bounded(df).mapInArrow(run, spark_schema)


def arrow_filter(df: DataFrame, task: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df, all columns unchanged, for which the task's function says True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = task()
        for batch in small(batches):
            yield batch.filter(pa.array(work(batch), pa.bool_()))

    return bounded(df).mapInArrow(run, df.schema)
