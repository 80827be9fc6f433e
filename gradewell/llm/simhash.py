"""SimHash near-duplicates found with pivot distance tables.

Every text has a 64-bit fingerprint. Texts with the same fingerprint are one
item from there on. For each item a table of Hamming distances to `PIVOTS`
reference fingerprints is made. Two items that differ in at most `max_bits` bits
differ by no more than that in any distance, so pairs are discarded by their
largest difference of distances, and only survivors are compared bit by bit.

So that not all pairs need to be looked at, items first meet where one of
max_bits + 1 blocks of bits is equal (with at most max_bits differing bits one
must be) and the distance to the first pivot agrees to within max_bits: an item
waits at its own distance and calls at the next max_bits distances as well.
Components of the surviving links, by star contraction, are the groups.

Defined results: texts without words (null, empty, white space) have the
fingerprint zero and link like any other; a text of fewer words than a shingle
is one shingle; repeated rows each give a row; rows without an id belong to a
group but never name it (a group of such rows alone has a null component_id);
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradewell.columns import col
from gradewell.llm.common import bounded, mix, raw_texts, small, split_words
from gradewell.llm.graph import bucket_links, components
from gradewell.workspace import staged

SHINGLE = 3
MAX_BITS = 2
PIVOTS = 16
SEED = 42


def fingerprint(words: list[bytes], size: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, name: str, size: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """df with its texts' fingerprints in one more column, a signed long."""
    at, schema = df.columns.index(text_col), StructType([*df.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = np.array([fingerprint(split_words(raw), size) for raw in raw_texts(batch.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, name])

    return bounded(df).mapInArrow(run, schema)


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def near_pairs(items: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links that span what items (column fp, distinct) within max_bits of each other join."""
    reference = pivots(n_pivots)
    edges = [round(64 * k / (max_bits + 1)) for k in range(max_bits + 2)]
    blocks = F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("bits"))
        for k, (low, high) in enumerate(zip(edges, edges[1:]))
    ])
    first = F.bit_count(col("fp").bitwiseXOR(F.lit(int(reference[0].astype(np.int64)))))
    rows = (
        items.select("fp", first.alias("own"))
        .select("fp", "own", F.explode(F.sequence("own", col("own") + max_bits)).alias("cell"))
        .select("fp", (col("cell") == col("own")).alias("home"), "cell", F.inline(blocks))
    )

    def accept(table: pa.Table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        distances = [np.bitwise_count(fp ^ p).astype(np.int8) for p in reference]

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            live = np.flatnonzero(home[i] | home[j])
            for d in distances:
                live = live[np.abs(d[i[live]] - d[j[live]]) <= max_bits]
            live = live[np.bitwise_count(fp[i[live]] ^ fp[j[live]]) <= max_bits]
            good = np.zeros(len(i), bool)
            good[live] = True
            return good

        return near

    return bucket_links(rows, ["block", "bits", "cell"], "fp", accept, "fp bigint, home boolean")


def _groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component) of every fingerprint in `prints` (doc_id, fp); component is the smallest fingerprint."""
    items = staged(prints.select("fp").distinct(), "fingerprints")
    linked = components(near_pairs(items, max_bits)).withColumnRenamed("node", "fp")
    return items.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    df: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    source = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    prints = staged(with_fingerprint(source, "fp", size).select("doc_id", "fp"), "prints")
    # One row per fingerprint from here: the copies of a text never meet in one task.
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(_groups(prints, max_bits), "fp")
    smallest = first.groupBy("component").agg(F.min("first").alias("component_id"))
    named = first.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(
    df: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of df, columns unchanged, without near-duplicates: of every group one
    row of the smallest id stays (a null id counts as the largest)."""
    fp, key = "__simhash_fp", "__simhash_id"
    rows = with_fingerprint(df, fp, size, text_col).withColumn(key, col(id_col).cast("bigint"))
    prints = staged(rows.select(col(key).alias("doc_id"), col(fp).alias("fp")), "prints")
    order = F.struct(col("doc_id").isNull().alias("none"), "doc_id", "fp")
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(_groups(prints, max_bits), "fp")
    chosen = best.groupBy("component").agg(F.min("best").alias("best")).select(
        F.col("best.doc_id").alias("__chosen_id"), F.col("best.fp").alias("__chosen_fp")
    )
    kept = rows.join(chosen, col(key).eqNullSafe(col("__chosen_id")) & (col(fp) == col("__chosen_fp")))
    return kept.dropDuplicates([key, fp]).select(*[col(c) for c in df.columns])
