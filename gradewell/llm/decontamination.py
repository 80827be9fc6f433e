"""Finds short test items inside long documents by MinHash containment search.

Documents are cut into windows whose size follows the items looked for: items
are partitioned by their number of shingles into classes of powers of two, and
a class with up to S shingles is searched in windows of 2 S shingles that
overlap by S, so that whatever a document holds of the item lies in windows of
comparable size. Every window and item has `hashes` minima under different
orders; a window with one minimum in common with an item of its class is a
candidate. Items of fewer than `SMALLEST_CLASS` shingles would fill too little of
a window: all their shingles are looked up in the documents instead, which
misses none. An exact check follows: the share of the item's distinct shingles
that the whole document contains must reach the threshold.

Documents are scanned where they lie, without a shuffle. Items are read in
blocks of bounded size, one pass over the documents each, so the item table may
be of any size.

Defined results: texts without words (null, empty, white space) are never
contaminated and no item; a text of fewer words than a shingle is one shingle,
its whole sequence; items with equal word sequences are one item under their
smallest id; each document row is judged by itself, also repeated rows and rows
without an id; empty tables give no rows (or leave all documents).
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import (
    Cache, arrow_filter, arrow_rows, chunks, hash64, multipliers, raw_texts, shingle_hashes, split_words, word_hashes,
)
from gradewell.workspace import scratch_path

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
# Smallest class of items, in shingles; those with fewer are looked up shingle by shingle.
SMALLEST_CLASS = 16
# Bytes of item texts in one block.
BLOCK_BYTES = 8_000_000
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Items:
    """One block of items, prepared for the tasks."""

    ids: list[int | None]
    copies: list[int]
    shingles: list[frozenset]
    size: int
    # by class: (hash, item) of every minimum, sorted by hash; one pair of arrays for each order
    classes: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    # (hash, item) of every shingle of the items below the smallest class, sorted by hash, and how many of them an item has
    short: tuple[np.ndarray, np.ndarray, np.ndarray]


def word_shingles(words: list[bytes], size: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _sequence_hash(words: np.ndarray) -> np.uint64:
    """For texts of fewer words than a shingle."""
    return shingle_hashes(words, len(words))[0]


def prepare_items(rows: list[tuple[int | None, bytes]], size: int, hashes: int) -> Items:
    merged: dict[bytes, list] = {}
    for item, raw in rows:
        if words := split_words(raw):
            merged.setdefault(b" ".join(words), []).append(item)
    ids = [min((i for i in group if i is not None), default=None) for group in merged.values()]
    copies = [len(group) for group in merged.values()]
    words = [text.split() for text in merged]
    by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
    cache, factors = Cache(hash64), multipliers(hashes)
    short: list[tuple[int, np.ndarray]] = []
    for i, w in enumerate(words):
        one = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
        found = shingle_hashes(one, size) if len(w) >= size else np.array([_sequence_hash(one)], np.uint64)
        if len(found) < SMALLEST_CLASS:
            short.append((i, np.unique(found)))
            continue
        cls = SMALLEST_CLASS
        while cls < len(found):
            cls *= 2
        by_class.setdefault(cls, []).append((i, found))
    classes = {}
    for cls, members in by_class.items():
        orders = []
        for f in factors:
            minima = np.array([(h * f).min() for _, h in members], np.uint64)
            order = np.argsort(minima, kind="stable")
            orders.append((minima[order], np.array([i for i, _ in members], np.int64)[order]))
        classes[cls] = orders
    known = np.concatenate([np.empty(0, np.uint64), *(h for _, h in short)])
    owner = np.repeat(np.array([i for i, _ in short], np.int64), [len(h) for _, h in short])
    order = np.argsort(known, kind="stable")
    looked_up = (known[order], owner[order], np.bincount(owner, minlength=len(words)))
    return Items(ids, copies, [frozenset(word_shingles(w, size)) for w in words], size, classes, looked_up)


def _short_candidates(docs: np.ndarray, hashes: np.ndarray, block: Items, threshold: float) -> set[tuple[int, int]]:
    """(document of the batch, item) pairs of the short items that share enough shingles."""
    known, owner, total = block.short
    low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
    at = np.flatnonzero(low < high)
    if not len(at):
        return set()
    count = high[at] - low[at]
    post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[at], count)
    once = np.unique(np.repeat(docs[at], count) * len(known) + post)  # a shingle counts once in a document
    pairs, shared = np.unique(once // len(known) * len(total) + owner[once % len(known)], return_counts=True)
    doc, item = pairs // len(total), pairs % len(total)
    enough = shared >= threshold * total[item]
    return set(zip(doc[enough].tolist(), item[enough].tolist()))


def _block_count(items: DataFrame, text_col: str) -> int:
    total = items.agg(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    return int(total // BLOCK_BYTES) + 1


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int, hashes: int, n: int):
    """The items in n blocks of bounded size, each collected when it is needed."""
    source = items.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    # Equal word sequences fall into one block.
    letters = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    part = F.pmod(F.xxhash64(F.regexp_replace(letters, r"[\x20\x09-\x0D]+", "")), F.lit(n))
    for k in range(n):
        rows = source.where(part == k).where(col("text").isNotNull()).collect()
        if rows:
            yield prepare_items([(r["id"], r["text"].encode()) for r in rows], size, hashes)


def _candidates(words: np.ndarray, starts: np.ndarray, block: Items, factors: np.ndarray, threshold: float) -> set[tuple[int, int]]:
    """(document of the batch, item) pairs with a minimum in common, or enough shingles of a short item."""
    size, counts = block.size, np.diff(starts)
    hashes = np.full(len(words), NEVER)
    full = shingle_hashes(words, size)
    hashes[: len(full)] = full
    valid = np.ones(len(words), bool)
    for k in range(1, size):  # the last words of a document begin no shingle
        at = starts[1:] - k
        valid[at[at >= starts[:-1]]] = False
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        hashes[starts[d]] = _sequence_hash(words[starts[d] : starts[d + 1]])
        valid[starts[d]] = True
    docs = np.repeat(np.arange(len(counts)), counts)[valid]
    hashes = hashes[valid]
    if not len(hashes):
        return set()
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    length = np.diff(np.r_[first, len(docs)])
    found = _short_candidates(docs, hashes, block, threshold)
    layout = {}
    for cls in block.classes:
        per_doc = -(-length // cls)
        number = np.arange(per_doc.sum()) - np.repeat(np.r_[0, np.cumsum(per_doc)[:-1]], per_doc)
        begin = np.repeat(first, per_doc) + number * cls
        owner = docs[begin]
        layout[cls] = (begin, owner, np.r_[owner[1:] == owner[:-1], False])
    for k, factor in enumerate(factors):
        ordered = hashes * factor
        for cls, orders in block.classes.items():
            begin, owner, goes_on = layout[cls]
            minimum = np.minimum.reduceat(ordered, begin)
            following = np.r_[minimum[1:], NEVER]
            window = np.where(goes_on, np.minimum(minimum, following), minimum)
            known, item = orders[k]
            low, high = np.searchsorted(known, window, "left"), np.searchsorted(known, window, "right")
            for w in np.flatnonzero(low < high):
                found.update((int(owner[w]), int(i)) for i in item[low[w] : high[w]])
    return found


def _matcher(block: Items, threshold: float):
    """texts -> [(document of the batch, item, shingles shared)], verified."""
    cache, factors = Cache(hash64), multipliers(len(next(iter(block.classes.values()), ())))

    def match(texts: list[bytes]) -> list[tuple[int, int, int]]:
        if not block.ids:
            return []
        by_doc: dict[int, list[int]] = {}
        for low, high in chunks(texts):
            words, starts = word_hashes(texts[low:high], cache)
            for doc, item in sorted(_candidates(words, starts, block, factors, threshold)):
                by_doc.setdefault(low + doc, []).append(item)
        out = []
        for doc, candidates in by_doc.items():
            there = word_shingles(split_words(texts[doc]), block.size)
            for item in candidates:
                shared = sum(s in there for s in block.shingles[item])
                if shared >= threshold * len(block.shingles[item]):
                    out.append((doc, item, shared))
        return out

    return match


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES,
) -> DataFrame:
    """(doc_id, item_id, item_copies, shared, shingles, containment): every item
    that a document contains to at least the threshold."""
    source = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return _found(source, items, item_id, item_text, size, threshold, hashes)


FOUND = "doc_id bigint, item_id bigint, item_copies bigint, shared bigint, shingles bigint, containment double"


def _found(source: DataFrame, items: DataFrame, item_id: str, item_text: str, size: int, threshold: float, hashes: int) -> DataFrame:
    """The hits of every block, written before the next block is collected; source holds the columns doc_id
    and text, and others that are returned with the hits."""
    spark, n = source.sparkSession, _block_count(items, item_text)
    others = [f for f in source.schema.fields if f.name not in ("doc_id", "text")]
    schema = FOUND + "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    more = [source.columns.index(f.name) for f in others]
    path, found = scratch_path(spark, "contained"), spark.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, size, hashes, n):

        def task(block=block):
            match = _matcher(block, threshold)

            def rows(batch: pa.RecordBatch) -> dict | None:
                hits = match(raw_texts(batch.column(1)))
                if not hits:
                    return None
                item, at = [i for _, i, _ in hits], pa.array([d for d, _, _ in hits], pa.int64())
                shared, total = [s for _, _, s in hits], [len(block.shingles[i]) for i in item]
                return {
                    "doc_id": pc.take(batch.column(0), at),
                    "item_id": [block.ids[i] for i in item], "item_copies": [block.copies[i] for i in item],
                    "shared": shared, "shingles": total, "containment": [s / t for s, t in zip(shared, total)],
                } | {batch.schema.names[k]: pc.take(batch.column(k), at) for k in more}

            return rows

        hits = arrow_rows(source, task, schema)
        if n == 1:
            return hits
        hits.write.mode("append").parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
    return found


def without_items(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES,
) -> DataFrame:
    """The documents that contain no item, rows and columns unchanged.

    One block of items is looked for where the documents are read. With more, the
    hits of all blocks are gathered first; documents are told apart by 128 bits of
    hashes of their texts, as equal texts contain the same items.
    """
    at = docs.columns.index(text_col)
    text = col(text_col).cast("string")
    if _block_count(items, item_text) > 1:
        keys = {"__one": F.xxhash64(text), "__two": F.xxhash64(F.lit("more"), text)}
        source = docs.select(F.lit(None).cast("bigint").alias("doc_id"), text.alias("text"), *[v.alias(k) for k, v in keys.items()])
        hit = _found(source, items, item_id, item_text, size, threshold, hashes).select(*keys).distinct()
        return docs.withColumns(keys).join(hit, [*keys], "left_anti").select(*[col(c) for c in docs.columns])
    for block in _blocks(items, item_id, item_text, size, hashes, 1):

        def task(block=block):
            match = _matcher(block, threshold)

            def keep(batch: pa.RecordBatch) -> list[bool]:
                hit = {d for d, _, _ in match(raw_texts(batch.column(at)))}
                return [i not in hit for i in range(batch.num_rows)]

            return keep

        docs = arrow_filter(docs, task)
    return docs
