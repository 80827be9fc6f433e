"""Exact substring dedup: removes bytes covered by long strings that occur more than once.

A byte goes if some string of `length` bytes (400) that covers it also starts
anywhere else in the corpus, the same text included. Repeats are found in
suffix arrays (suffix_groups.py), made in tasks for strings that can be equal:

1. Every window of `length` bytes has an anchor: of the `GRAM`-byte strings in
   it the one with the smallest hash, the last of several. Equal windows have
   equal anchors at the same offset, so only windows with a common anchor need
   to be compared. Consecutive windows with one anchor are a run.
2. Runs that agree in all their bytes are one class. Windows of a class with
   two members repeat; windows of the only run with its anchor do not.
3. What is left, runs that share their anchor but not all their bytes, is cut
   into blocks of `BLOCKS[0]` windows. All windows of a block contain the same
   middle; blocks with a common middle are written as strings of their bytes
   before it, one symbol for the middle, and their bytes after it. A suffix
   array over the strings of many middles shows which windows repeat.
4. A middle with more than `GROUP` different strings is not given to one task:
   its blocks are cut into smaller ones with longer middles, down to single
   windows, which are counted.

Classes are counted before they are shuffled, so copies of a text never meet in
one task. Comparisons go by 128 bits of hash and exact bytes around the middle.

Defined results: null is the empty text; texts shorter than `length` lose
nothing; equal rows are texts of their own (each repeats the other); rows
without an id are treated like others; an empty table gives no rows; columns
besides the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import arrow_rows, chunks, mix, raw_texts, schema_of
from gradewell.llm.suffix_groups import repeated_prefixes
from gradewell.workspace import staged

LENGTH = 400
GRAM = 200
BLOCKS = (32, 8, 2, 1)
# Different strings around one middle that one task compares.
GROUP = 1_024
# Symbols of one suffix array.
ARRAY = 50_000
# Window starts that are looked at together; a longer text is gone through in parts.
SEGMENT = 1 << 17

RATIO = 0x5851F42D4C957F2D  # odd
BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of byte strings from running sums, modulo 2^64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            step, back = np.full(n, RATIO, np.uint64), np.full(n, pow(RATIO, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        out = np.zeros(n, np.uint64)
        np.cumsum(BYTE[data] * self.up[: n - 1], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """Runs of one stretch of bytes: text (its number), first and last window start
    and anchor position (all counted in the stretch), anchor and class hashes."""

    def __init__(self, rolling: Rolling, data: np.ndarray, ends: np.ndarray, length: int, gram: int):
        sums = rolling.sums(data)
        n = len(data) - gram + 1
        grams = mix((sums[gram:] - sums[:-gram]) * rolling.down[:n])
        low = np.uint64((1 << 31) - 1)
        keyed = (grams & ~low) | (low - np.arange(n, dtype=np.uint64))  # ties: the last
        anchor = (low - (sliding_minimum(keyed, length - gram + 1) & low)).astype(np.int64)
        starts = np.r_[0, ends[:-1]]
        windows = ends - starts - length + 1
        start = np.arange(windows.sum()) + np.repeat(starts - np.r_[0, np.cumsum(windows)[:-1]], windows)
        anchor = anchor[start]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
        at = np.flatnonzero(new)
        self.first, self.last = start[at], start[np.r_[at[1:], len(start)] - 1]
        self.anchor = anchor[at]
        self.text = np.searchsorted(ends, self.first, "right")
        self.key = grams[self.anchor].view(np.int64)
        whole = rolling.hashes(sums, self.first, self.last + length)
        self.cls = mix(whole + (self.anchor - self.first).astype(np.uint64)).view(np.int64)
        self.sums, self.rolling = sums, rolling


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends of the texts in them, which texts, where in its text each begins) for all
    texts of at least `length` bytes; a long text comes in parts that overlap by length - 1."""
    for low, high in chunks(texts, SEGMENT):
        parts, who, begin = [], [], []
        for i in range(low, high):
            for b in range(0, len(texts[i]) - length + 1, SEGMENT):
                parts.append(texts[i][b : b + SEGMENT + length - 1])
                who.append(i)
                begin.append(b)
                if len(parts[-1]) > SEGMENT:
                    yield _stretch(parts, who, begin)
                    parts, who, begin = [], [], []
        if parts:
            yield _stretch(parts, who, begin)


def _stretch(parts: list[bytes], who: list[int], begin: list[int]):
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(who), np.array(begin)


def _classes_of(texts: list[bytes], length: int, gram: int, rolling: Rolling) -> list[list[dict]]:
    """Per text the anchor and class of its runs, and how many runs are alike."""
    out: list[list[dict]] = [[] for _ in texts]
    for data, ends, who, _ in stretches(texts, length):
        runs = Runs(rolling, data, ends, length, gram)
        table = np.stack([who[runs.text], runs.key, runs.cls], 1)
        table, counts = np.unique(table, axis=0, return_counts=True)
        for (text, key, cls), n in zip(table.tolist(), counts.tolist()):
            out[text].append({"key": key, "cls": cls, "n": n})
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _summary(raw: bytes, spans: list[tuple[int, int]]) -> dict:
    kept = hashlib.sha256()
    at = 0
    for start, stop in spans:
        kept.update(memoryview(raw)[at:start])
        at = stop
    kept.update(memoryview(raw)[at:])
    return {
        "n_bytes": len(raw), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest(),
        "spans": [{"start": a, "stop": b} for a, b in spans],
    }


SPANS = "array<struct<start: bigint, stop: bigint>>"
RESULT = f"n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}"
BLOCK = "struct<key: bigint, middle: bigint, head: binary, tail: binary, start: bigint>"


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Per text its runs and what it is if nothing is removed."""

    def task():
        rolling = Rolling()

        def rows(batch: pa.RecordBatch) -> dict:
            texts = raw_texts(batch.column(2))
            return {
                "doc_id": batch.column(0), "text_hash": batch.column(1), "n_bytes": [len(t) for t in texts],
                "sha": [hashlib.sha256(t).hexdigest() for t in texts], "runs": _classes_of(texts, length, gram, rolling),
            }

        return rows

    schema = "doc_id bigint, text_hash bigint, n_bytes bigint, sha string, runs array<struct<key: bigint, cls: bigint, n: bigint>>"
    return arrow_rows(docs, task, schema)


def _blocks(runs: Runs, at: int, data: np.ndarray, base: int, length: int, width: int) -> list[dict]:
    """A run's windows in blocks on a grid that begins at its anchor."""
    out = []
    p, first, last, key = int(runs.anchor[at]), int(runs.first[at]), int(runs.last[at]), int(runs.key[at])
    j = (p - last) // width
    while True:
        b = p - j * width  # windows b - width + 1 .. b, as far as the run has them
        a = b - width + 1
        low, high = max(a, first), min(b, last)
        if high < first:
            return out
        if low <= high:
            middle = runs.rolling.hashes(runs.sums, np.array([b]), np.array([a + length]))[0]
            out.append({
                "key": key, "middle": int((mix(np.array([middle + np.uint64(j)]))[0]).astype(np.int64)),
                "head": data[low:b].tobytes(), "tail": data[a + length : high + length].tobytes(), "start": base + low,
            })
        j += 1


REPEATED, OPEN, SPEAKS = 0, 1, 2  # a run whose class repeats; one alone in its class; one that repeats and stands for its class


def _resolve(texts: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Texts with their verdicts -> spans known to repeat, and blocks to be compared."""

    def task():
        rolling = Rolling()

        def rows(batch: pa.RecordBatch) -> dict:
            raws = raw_texts(batch.column(2))
            verdicts = [{(v["key"], v["cls"]): v["state"] for v in row} for row in batch.column(3).to_pylist()]
            spans: list[list] = [[] for _ in raws]
            blocks: list[list] = [[] for _ in raws]
            undecided = [False] * len(raws)
            for data, ends, who, begin in stretches(raws, length):
                runs = Runs(rolling, data, ends, length, gram)
                starts = np.r_[0, ends[:-1]]
                for at, (t, key, cls) in enumerate(zip(runs.text.tolist(), runs.key.tolist(), runs.cls.tolist())):
                    text = int(who[t])
                    state = verdicts[text].get((key, cls))
                    if state is None:
                        continue
                    base = int(begin[t] - starts[t])
                    if state != OPEN:
                        spans[text].append((base + int(runs.first[at]), base + int(runs.last[at]) + length))
                    if state != REPEATED:
                        blocks[text] += _blocks(runs, at, data, base, length, width)
                        undecided[text] = undecided[text] or state == OPEN
            known = [merged(s) for s in spans]
            done = [_summary(raw, s) for raw, s in zip(raws, known)]
            return {
                "doc_id": batch.column(0), "text_hash": batch.column(1),
                **{k: [d[k] for d in done] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")},
                "blocks": blocks, "undecided": undecided, "text": [raw if u else None for raw, u in zip(raws, undecided)],
            }

        return rows

    return arrow_rows(texts, task, f"doc_id bigint, text_hash bigint, {RESULT}, blocks array<{BLOCK}>, undecided boolean, text binary")


CONTEXT = "key bigint, middle bigint, head binary, tail binary"


def _compare(contexts: DataFrame, width: int) -> DataFrame:
    """(key, middle, head, tail, repeated): the offsets of the windows of each
    different string that another string of the same middle has as well."""
    dealt = contexts.select("key", "middle", "head", "tail").repartition("key", "middle").sortWithinPartitions("key", "middle")
    schema = schema_of(CONTEXT + ", repeated array<int>")

    def judge(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        symbols, starts, owner, offset, at, middles = [], [], [], [], 0, {}
        for i, (key, middle, head, tail) in enumerate(rows):
            symbol = 257 + middles.setdefault((key, middle), len(middles))
            before, after = (np.frombuffer(part, np.uint8).astype(np.int64) + 1 for part in (head, tail))
            symbols.append(np.r_[before, symbol, after, 0])
            # Windows start at the bytes of the head, and at the middle, as far as the tail reaches.
            here = np.arange(len(head) + 1 + len(tail) - width + 1)
            starts.append(at + here)
            owner.append(np.full(len(here), i))
            offset.append(here)
            at += len(symbols[-1])
        text = np.concatenate(symbols)
        hit = repeated_prefixes(text, np.concatenate(starts), width)
        owner, offset = np.concatenate(owner)[hit], np.concatenate(offset)[hit]
        cut = np.searchsorted(owner, np.arange(len(rows) + 1))
        found = [offset[cut[i] : cut[i + 1]].astype(np.int32) for i in range(len(rows))]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_pydict({"key": columns[0], "middle": columns[1], "head": columns[2], "tail": columns[3], "repeated": found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if symbols >= ARRAY and row[:2] != held[-1][:2]:
                    yield judge(held)
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[2]) + len(row[3]) + 2
        if held:
            yield judge(held)

    return dealt.mapInArrow(run, schema)


def _finer(contexts: DataFrame, width: int, finer: int) -> DataFrame:
    """Every block of `width` windows as blocks of `finer` windows with longer middles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "key", "middle", "head", "tail", "start")}
            for row, key, middle, head, tail, start in zip(*(batch.column(k).to_pylist() for k in range(6))):
                # Windows w = 0 .. width - 1 of the whole block; this one has those from `low` to `high`.
                low, high = width - 1 - len(head), len(tail)
                for a in range(0, width, finer):
                    b = a + finer - 1
                    if b < low or a > high:
                        continue
                    # The longer middle adds the bytes before it from window b on, and those after it up to window a.
                    more = head[b - low :] if b >= low else b""
                    text = b"%d %d %d " % (middle, a, len(more)) + more + tail[:a]
                    digest = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                    first, last = max(a, low), min(b, high)
                    out["row"].append(row)
                    out["key"].append(key)
                    out["middle"].append(digest)
                    out["head"].append(head[first - low : b - low])
                    out["tail"].append(tail[a:last])
                    out["start"].append(start + first - low)
            yield pa.RecordBatch.from_pydict(out, schema=BLOCK_ROWS)

    return contexts.mapInArrow(run, schema_of("row bigint, " + CONTEXT + ", start bigint"))


BLOCK_ROWS = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("middle", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("start", pa.int64())])


def _repeated_windows(blocks: DataFrame, widths: tuple[int, ...], group: int) -> DataFrame:
    """(row, start, stop): runs of repeated window starts (stop past the last) of `blocks` (row, key, middle, head, tail, start)."""
    found = None
    for k, width in enumerate(widths):
        contexts = blocks.groupBy("key", "middle", "head", "tail").agg(F.count("*").alias("n"))
        contexts = staged(contexts, "contexts")
        sizes = contexts.groupBy("key", "middle").agg(F.count("*").alias("strings"), F.sum("n").alias("all")).where(col("all") > 1)
        sizes = staged(sizes, "middles")
        judged = contexts.join(sizes.where((col("strings") > 1) & (col("strings") <= group)).select("key", "middle"), ["key", "middle"])
        last = k + 1 == len(widths)
        # Copies of a whole string repeat in all its windows; the rest is for the suffix array.
        copies = contexts.where(col("n") > 1).select("key", "middle", "head", "tail")
        names = ["key", "middle", "head", "tail"]
        whole = blocks.join(copies, names).select(
            "row", "start", (col("start") + F.length("head") + F.length("tail") - (width - 2)).alias("stop")
        )
        parts = [whole]
        if width > 1:
            hits = _compare(judged, width).where(F.size("repeated") > 0)
            offsets = blocks.join(hits, names).select("row", "start", F.explode("repeated").alias("offset"))
            parts.append(offsets.select("row", (col("start") + col("offset")).alias("start"), (col("start") + col("offset") + 1).alias("stop")))
        for part in parts:
            found = part if found is None else found.unionByName(part)
        large = sizes.where(col("strings") > group).select("key", "middle")
        if last or width == 1 or large.isEmpty():
            break
        blocks = staged(_finer(blocks.join(large, ["key", "middle"]).select("row", *names, "start"), width, widths[k + 1]), "finer")
    return found


def repeated_bytes(
    df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    widths: tuple[int, ...] = BLOCKS, group: int = GROUP,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are the maximal removed runs."""
    text = col(text_col).cast("string")
    docs = df.select(col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scan = staged(_scan(docs, length, gram), "scan")
    runs = scan.select("doc_id", "text_hash", F.inline("runs"))
    shared = runs.groupBy("key").agg(F.sum("n").alias("all")).where(col("all") > 1).select("key")
    runs = staged(runs.join(shared, "key"), "shared-runs")
    # Classes; the text that stands for one (all texts of one id and hash are alike).
    place = F.struct("doc_id", "text_hash")
    classes = runs.groupBy("key", "cls").agg(F.sum("n").alias("n"), F.min(place).alias("speaker"))
    per_key = classes.groupBy("key").agg(F.count("*").alias("classes"))
    classes = staged(classes.join(per_key, "key"), "classes")  # so the join below may split a class of many runs
    speaks = (col("classes") > 1) & F.col("speaker.doc_id").eqNullSafe(col("doc_id")) & (F.col("speaker.text_hash") == col("text_hash"))
    state = F.when(col("total") == 1, OPEN).when(speaks, SPEAKS).otherwise(REPEATED)
    verdicts = (
        runs.drop("n").join(classes.withColumnRenamed("n", "total"), ["key", "cls"])
        .select("doc_id", "text_hash", F.struct("key", "cls", state.alias("state")).alias("verdict"))
        .groupBy(col("doc_id").alias("__id"), col("text_hash").alias("__hash")).agg(F.collect_set("verdict").alias("verdicts"))
    )
    verdicts = staged(verdicts, "verdicts")
    same = col("doc_id").eqNullSafe(col("__id")) & col("text_hash").eqNullSafe(col("__hash"))
    texts = docs.join(verdicts, same).select("doc_id", "text_hash", "text", "verdicts")
    resolved = staged(_resolve(texts, length, gram, widths[0]).withColumn("row", F.monotonically_increasing_id()), "resolved")

    windows = _repeated_windows(staged(resolved.select("row", F.inline("blocks")), "blocks"), widths, group)
    more = windows.groupBy("row").agg(F.collect_list(F.struct("start", (col("stop") + (length - 1)).alias("stop"))).alias("more"))
    open_texts = resolved.where("undecided").select("row", "doc_id", "text", "spans").join(more, "row", "left")

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            known, added = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [
                _summary(raw, merged([(s["start"], s["stop"]) for s in [*a, *(b or [])]]))
                for raw, a, b in zip(raw_texts(batch.column(1)), known, added)
            ]
            return {"doc_id": batch.column(0)} | {k: [d[k] for d in done] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}

        return rows

    finished = arrow_rows(open_texts.select("doc_id", "text", "spans", "more"), task, f"doc_id bigint, {RESULT}")
    settled = resolved.where(~col("undecided")).select(*finished.columns)
    untouched = scan.join(verdicts.select("__id", "__hash"), same, "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        col("sha").alias("kept_sha256"), F.expr(f"cast(array() as {SPANS})").alias("spans"),
    )
    return untouched.unionByName(settled).unionByName(finished)
