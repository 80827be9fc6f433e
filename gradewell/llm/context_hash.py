"""Context-triggered piecewise hashes of texts, and how alike two of them are.

A hash of the last 7 bytes rolls over the UTF-8 bytes of a text. A chunk ends
after every byte whose rolling hash ends in `level` zero bits, so chunks are cut
by what they hold and an edit changes only the chunks around it. A chunk that
occurs again counts once, at its first place. The level is the lowest one that
gives at most CHUNKS chunks, as all levels above it do. A fingerprint is
`level:signature:...`: two letters (12 bits) per chunk, at its level and at each
of the next three. Whole texts count; long ones are read in blocks.

Two fingerprints are compared at the lowest level that both have: with d the edit
distance of the signatures there (chunks put in or taken out; an exchanged one
counts twice), likeness is 1 - d / (sum of the two lengths). Without a common
level they are not comparable: 0. Equal fingerprints have likeness 1.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gradewell.columns import col
from gradewell.llm.common import arrow_rows, bounded, mix, raw_texts, schema_of, small
from gradewell.workspace import BROADCAST_ROWS, expand_copies, staged

ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
WINDOW = 7
CHUNKS = 64
SIGNATURES = 4
BLOCK = 1 << 16
ALL = (1 << 64) - 1
TOP = 64  # the level of a text's last byte
LETTERS = [x + y for x in ALPHABET for y in ALPHABET]
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, WINDOW + 1)]
# Equal documents (id and text) beyond this many, and beyond one row in BROADCAST_ROWS, are handled as one with a count.
COPIES = 1_000
# Documents in order of their ids are dealt into at most this many ranges, whose first keys go to the driver.
RANGES = 10_000
RANGE_ROWS = 2_000


def _rolling(joined: np.ndarray, gaps: np.ndarray, edges: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, level, sum of all hashes so far) where the rolling hash ends in `low` zero bits or more, and at the edges."""
    places, levels, sums, total = [], [], [], np.uint64(0)
    mask = np.uint64((1 << low) - 1)
    for start in range(0, len(joined), BLOCK):
        stop = min(start + BLOCK, len(joined))
        first, n = max(start - WINDOW + 1, 0), stop - start
        data = np.zeros(n + WINDOW - 1, np.uint64)
        shift = len(data) - stop
        data[first + shift :] = joined[first:stop]
        data[first + shift :] += np.uint64(1)
        data[gaps[(gaps >= first) & (gaps < stop)] + shift] = 0
        rolling = data[WINDOW - 1 :] * FACTORS[0]
        for k in range(1, WINDOW):
            rolling += data[WINDOW - 1 - k : WINDOW - 1 - k + n] * FACTORS[k]
        rolling = mix(rolling)
        so_far = np.cumsum(rolling) + total
        total = so_far[-1]
        chosen = (rolling & mask) == 0
        chosen[edges[(edges >= start) & (edges < stop)] - start] = True
        at = np.flatnonzero(chosen)
        last_bit = rolling[at] & (~rolling[at] + np.uint64(1))
        places.append(at + start)
        levels.append(np.log2(np.maximum(last_bit, 1).astype(np.float64)).astype(np.int8))
        sums.append(so_far[at])
    places = np.concatenate(places)
    levels = np.concatenate(levels)
    levels[np.searchsorted(places, edges)] = TOP
    return places, levels, np.concatenate(sums)


def _lowest(n: int) -> int:
    """Levels of a text of n bytes begin here, so that what is kept of a long text stays small."""
    return max(1, (n // CHUNKS).bit_length() - 8)


def _chunks(sums: np.ndarray, before: int) -> dict[int, None]:
    """The hashes of the chunks that end with these sums, each once, at its first place."""
    values = sums.tolist()
    return dict.fromkeys([(x - y) & ALL for x, y in zip(values, [before, *values])])


def _prints(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts that are not empty, taken side by side with a gap before each."""
    gap = bytes(WINDOW - 1)
    joined = np.frombuffer(gap + gap.join(texts), np.uint8)
    sizes = [len(t) for t in texts]
    starts = np.cumsum([0, *sizes[:-1]]) + len(gap) * np.arange(1, len(texts) + 1)
    ends = starts + np.array(sizes)
    gaps = (starts[:, None] - len(gap) + np.arange(len(gap))).ravel()
    edges = np.unique(np.r_[starts - 1, ends - 1])
    places, levels, sums = _rolling(joined, gaps, edges, min(map(_lowest, sizes)))
    found = []
    for n, a, b in zip(sizes, np.searchsorted(places, starts - 1).tolist(), np.searchsorted(places, ends).tolist()):
        level_of, so_far = levels[a + 1 : b], sums[a + 1 : b]
        before = int(sums[a])
        lowest = _lowest(n)
        counts = np.bincount(level_of, minlength=TOP + 1)[::-1].cumsum()[::-1]
        level = lowest + int(np.argmax(counts[lowest:] <= CHUNKS))
        while level > lowest and len(_chunks(so_far[level_of >= level - 1], before)) <= CHUNKS:
            level -= 1
        here = np.flatnonzero(level_of >= level)
        parts = [str(level)]
        for k in range(level, level + SIGNATURES):
            here = here[level_of[here] >= k]
            parts.append("".join([LETTERS[x >> 52] for x in _chunks(so_far[here], before)]))
        found.append(":".join(parts))
    return found


def fingerprints_of(texts: list[bytes]) -> list[str]:
    """The fingerprint of every text; they do not depend on what else is in the list."""
    found = ["1" + ":" * SIGNATURES] * len(texts)
    group: list[int] = []
    size = 0
    for i, raw in enumerate(texts):
        if not raw:
            continue
        if group and size + len(raw) > BLOCK:
            for j, x in zip(group, _prints([texts[j] for j in group])):
                found[j] = x
            group, size = [], 0
        group.append(i)
        size += len(raw)
    if group:
        for j, x in zip(group, _prints([texts[j] for j in group])):
            found[j] = x
    return found


def _alike(a: str, b: str) -> float:
    """1 - edit distance / (sum of lengths) of two signatures, by the longest common subsequence in bit-parallel form."""
    n, m = len(a) // 2, len(b) // 2
    if not n + m:
        return 1.0
    places: dict[str, int] = {}
    for i in range(n):
        x = a[2 * i : 2 * i + 2]
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << n) - 1
    row = whole
    for i in range(m):
        match = row & places.get(b[2 * i : 2 * i + 2], 0)
        if match:
            row = ((row + match) | (row - match)) & whole
    return 2 * (n - row.bit_count()) / (n + m)


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    one, two = a.split(":"), b.split(":")
    apart = int(two[0]) - int(one[0])
    if abs(apart) >= SIGNATURES:
        return 0.0
    return _alike(one[1 + max(apart, 0)], two[1 + max(-apart, 0)])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; a null text counts as empty. Nothing is shuffled."""

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            texts = raw_texts(batch.column(1))
            return {
                "doc_id": batch.column(0), "n_chars": [len(raw.decode()) for raw in texts],
                "fingerprint": fingerprints_of(texts),
            }

        return rows

    source = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return arrow_rows(source, task, "doc_id bigint, n_chars bigint, fingerprint string")


def likeness_of(a: Column, b: Column) -> Column:
    """likeness() of two columns of fingerprints; null if one is null."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return compare(a, b)


def spliced(text: str, following: str) -> str:
    """The text with its last third replaced by as many first letters of the following one, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


KEY = ["unnumbered", "place", "h", "g"]
NEXT_SCHEMA = (
    "doc_id bigint, n_chars bigint, fingerprint string, edited string, edited_fingerprint string, "
    "near_edited double, near_next double, copies bigint"
)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the key they are ordered by: descending id, null last, then two hashes of the text."""
    rows = df.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(
        "doc_id", "text", col("doc_id").isNull().alias("unnumbered"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("place"),
        F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("g"),
    )


def _next_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (range, extra, doc_id, text, copies) in order: each with the row after it. A range ends with a
    row of the next one (extra), which only serves the last of its own."""
    here = held = None
    for batch in small(batches):
        columns = [batch.column(i).to_pylist() for i in range(5)]
        pairs = []
        for at, extra, number, text, copies, own in zip(*columns, fingerprints_of([t.encode() for t in columns[3]])):
            if at != here:
                here, held = at, None
            elif held is None:
                continue  # one more copy of the row that only serves the last one
            row = (number, text, own)
            if held is not None:
                pairs.append((held, row, 1))
            if not extra and copies > 1:
                pairs.append((row, row, copies - 1))
            held = None if extra else row
        if not pairs:
            continue
        edited = [spliced(row[1], after[1]) for row, after, _ in pairs]
        prints = fingerprints_of([t.encode() for t in edited])
        out = {
            "doc_id": [row[0] for row, _, _ in pairs], "n_chars": [len(row[1]) for row, _, _ in pairs],
            "fingerprint": [row[2] for row, _, _ in pairs], "edited": edited, "edited_fingerprint": prints,
            "near_edited": [likeness(row[2], x) for (row, _, _), x in zip(pairs, prints)],
            "near_next": [likeness(row[2], after[2]) for row, after, _ in pairs], "copies": [n for _, _, n in pairs],
        }
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its fingerprint, its text spliced with the next document's, and how alike they are.

    Next is the following row by descending id, the first after the last. Rows
    without an id come last, rows of one id are ordered by two 64-bit hashes of
    their texts, a null text counts as empty, equal rows follow one another, and
    a single row follows itself. Texts are shuffled once, dealt into ranges of
    the order; only the first key of every range goes to the driver. Of a
    document that is repeated in more than one row of BROADCAST_ROWS one row is
    sent, with a count.

    Returns (doc_id, n_chars, fingerprint, edited, edited_fingerprint, near_edited, near_next).
    """
    columns = [c for c in schema_of(NEXT_SCHEMA).names if c != "copies"]
    rows = _keyed(df, id_col, text_col)
    keys = staged(rows.groupBy(*KEY).agg(F.count("*").alias("copies")), "document-keys")
    total = keys.agg(F.sum("copies")).first()[0] or 0
    if not total:
        return rows.sparkSession.createDataFrame([], schema_of(NEXT_SCHEMA)).select(*columns)
    ranges = min(RANGES, total // RANGE_ROWS + 1)
    dealt = keys.repartitionByRange(ranges, *KEY).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEY)).alias("k"))
    cuts = sorted(tuple(r["k"]) for r in dealt.collect())

    many = keys.where((col("copies") > COPIES) & (col("copies") * BROADCAST_ROWS >= total))
    rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    if hot := not many.isEmpty():
        once = rows.drop("copies").join(F.broadcast(many), KEY).groupBy("doc_id", *KEY, "copies").agg(F.first("text").alias("text"))
        rows = rows.join(F.broadcast(many.drop("copies")), KEY, "left_anti").unionByName(once.select(*rows.columns))

    @F.pandas_udf("bigint")
    def place_of(unnumbered: pd.Series, place: pd.Series, h: pd.Series, g: pd.Series) -> pd.Series:
        """Twice the range of a key, one more if it is its first."""
        found = []
        for key in zip(unnumbered.tolist(), place.tolist(), h.tolist(), g.tolist()):
            at = bisect_right(cuts, key) - 1
            found.append(2 * at + (cuts[at] == key))
        return pd.Series(found, dtype="int64")

    own = F.struct(F.shiftright("code", 1).alias("range"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.shiftright("code", 1) - 1, F.lit(len(cuts))).alias("range"), F.lit(True).alias("extra"))
    placed = rows.withColumn("code", place_of(*KEY)).withColumn(
        "at", F.explode(F.when(col("code") % 2 == 1, F.array(own, before)).otherwise(F.array(own)))
    )
    placed = placed.select("at.range", "at.extra", "doc_id", "text", "copies", *KEY)
    ordered = placed.repartition("range").sortWithinPartitions("range", "extra", *KEY)
    schema = schema_of(NEXT_SCHEMA)
    arrow_schema = to_arrow_schema(schema)
    ordered = bounded(ordered.select("range", "extra", "doc_id", "text", "copies"))
    found = ordered.mapInArrow(lambda batches: _next_rows(batches, arrow_schema), schema)
    return (expand_copies(found, "copies") if hot else found).select(*columns)
