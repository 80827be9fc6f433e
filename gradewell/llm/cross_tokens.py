"""Alignment of two tokenizers over the same bytes, and how often their tokens end together.

Every text is tokenized twice: byte-level BPE (A) over a space and the text, a
sentencepiece model (B) over the text, to which it adds that space itself. Byte
offsets where tokens of both end cut the text into groups; the pairs of tokens
that end there are links.

Counting the links of the whole corpus is an external merge. Tasks write runs:
the links of some documents, sorted by B's token, then A's, with one table of
pair totals per radix partition (the low bits of B's id), zstd-compressed. One
task per radix partition merges the tables of all runs with a heap. As all pairs
of a B token follow one another there, its largest count is known when it ends,
and the counts go back to the runs in the order of their own tables. Each run
then adds them up by document. So a pair that a third of all documents hold is
one entry per run in the merge, and no document leaves its run.

Defined results: texts that are null, empty or not covered byte by byte by both
tokenizers (an unknown character, a mark that stands for a space) have no tokens:
zeros and no groups. Special tokens inside texts are plain text. Every input row
gives one row, equal rows equal ones; an empty table gives an empty one; columns
besides the id and the text are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gradewell.columns import col
from gradewell.llm.common import bounded, schema_of, small
from gradewell.workspace import staged

SPACE_MARK = "▁"
# Links of a run, which a task holds and sorts at once.
RUN_LINKS = 1_000_000
# Radix partitions: tasks that merge, each the runs' pairs of some tokens of B.
PARTS = 64
# Segments (words with what follows them) that a task keeps between runs; results do not depend on it.
SEGMENTS = 300_000
# Documents whose new segments are aligned together.
TOGETHER = 64

DOCUMENT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
PLACED = f"run bigint, place int, {DOCUMENT}, part int, blob binary"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers over segments of texts."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocabulary = {t: i for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(x in letters for x in t)}
        bytes_a = {i: bytes([letters[x] for x in t]) for t, i in vocabulary.items()}
        # Ids are in the order of the merges, so the same vocabulary serves as ranks of a faster encoder.
        self.fast = Encoding("a", pat_str=PATTERN, mergeable_ranks={raw: i for i, raw in bytes_a.items()}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a = np.zeros(max(bytes_a) + 1, np.int64)
        self.size_a[list(bytes_a)] = [len(x) for x in bytes_a.values()]
        self.sizes_a = self.size_a.tolist()
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Segments are independent unless a piece goes over a space.
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def segments(self, text: str) -> list[str]:
        """The text cut before every single space between two characters that are no white space."""
        if not self.splits or SPACE_MARK in text:
            return [text]
        parts = text.split(" ")
        if parts[0] and parts[-1] and not WIDE_SPACE.search(text):
            return parts
        joined = [parts[0]]
        for p in parts[1:]:
            last = joined[-1]
            if not last or not p or last[-1].isspace() or p[0].isspace():
                joined[-1] = f"{last} {p}"
            else:
                joined.append(p)
        return joined

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        """Ids of a space and each segment. Beyond Latin letters the two encoders might class characters differently."""
        fast, slow = self.fast.encode_ordinary, self.a.encode
        return [fast(" " + s) if max(s, default="") < LATIN_END else slow(" " + s, add_special_tokens=False).ids for s in segments]


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE_SPACE = re.compile(r" \s|\s ")
LATIN_END = "\u0250"


class _Known:
    """Segments that have been aligned: their numbers, tokens, groups and links."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_groups: list[int] = []
        self.sizes: list[np.ndarray] = []  # per lot: rows (tokens of A, tokens of B, links)
        self.links: list[np.ndarray] = []  # per lot: B << 32 | A of every link

    def learn(self, segments: list[str]) -> None:
        """Align these segments, side by side. Where bytes differ from the text the number is -1."""
        one = self.aligner
        size_a = one.sizes_a
        a, b = one.encode_a(segments), one.b.encode(segments, num_threads=1)
        good = []
        for i, (s, x, y) in enumerate(zip(segments, a, b)):
            if y and b"".join([one.bytes_b[t] for t in y]) == (raw := (" " + s).encode()) and sum([size_a[t] for t in x]) == len(raw):
                self.number[s] = len(self.groups) + len(good)
                good.append(i)
            else:
                self.number[s] = -1
        if not good:
            return
        a, b = [a[i] for i in good], [b[i] for i in good]
        sizes = np.array([[len(x) for x in a], [len(y) for y in b], [0] * len(good)], np.int64)
        flat_a, flat_b = (np.fromiter((t for x in side for t in x), np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(one.size_a[flat_a]), np.cumsum(one.size_b[flat_b])
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        done = np.cumsum(last_a)[np.cumsum(sizes[0]) - 1]  # a group ends with every segment
        sizes[2] = np.diff(done, prepend=0)
        self.sizes.append(sizes)
        self.links.append(flat_b[last_b] << 32 | flat_a[last_a])
        self.n_groups += sizes[2].tolist()
        last_a, last_b, i, j = last_a.tolist(), last_b.tolist(), 0, 0
        for x, y, n in zip(a, b, sizes[2].tolist()):
            if n == 1:
                self.groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            else:
                parts = "".join([f"{t}{'|' if end else ','}" for t, end in zip(x, last_a[i : i + len(x)])]).split("|")
                others = "".join([f"{t}{';' if end else ','}" for t, end in zip(y, last_b[j : j + len(y)])]).split(";")
                self.groups.append(";".join([f"{p}|{q}" for p, q in zip(parts[:-1], others[:-1])]))
            i, j = i + len(x), j + len(y)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, the first as differences, zstd-compressed."""
    first = np.diff(columns[0], prepend=0).astype(np.int64)
    size = np.array([len(first)], np.int64)
    return zstandard.compress(b"".join([size.tobytes(), first.tobytes(), *[c.astype(np.int32).tobytes() for c in columns[1:]]]), 1)


def _unpacked(blob: bytes, others: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    first = np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [first, *[np.frombuffer(raw, np.int32, n, 8 + 8 * n + 4 * n * k) for k in range(others)]]


class _Run:
    """Documents and their links until there are enough for a run."""

    def __init__(self, number: int, known: _Known, parts: int):
        self.number, self.known, self.parts = number, known, parts
        self.ids: list[int | None] = []
        self.groups: list[str] = []
        self.segments: list[np.ndarray] = []
        self.links = 0

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        known = self.known
        segments = [known.aligner.segments(t) if t else [] for t in texts]
        if new := dict.fromkeys(s for some in segments for s in some if s not in known.number):
            known.learn(list(new))
        for doc_id, text, some in zip(doc_ids, texts, segments):
            numbers = [known.number[s] for s in some]
            if -1 in numbers and len(some) > 1:
                # bytes that one segment lacks could only come back in another: the whole text decides
                if text not in known.number:
                    known.learn([text])
                numbers = [known.number[text]]
            if -1 in numbers:
                numbers = []
            if numbers:
                self.segments.append(np.array([numbers, [len(self.ids)] * len(numbers)], np.int64))
                self.links += sum([known.n_groups[n] for n in numbers])
            self.ids.append(doc_id)
            self.groups.append(";".join([known.groups[n] for n in numbers]))

    def rows(self, names: list[str]) -> dict:
        """Document rows, one row of pair totals per radix partition, and one of the links themselves (partition -1)."""
        count, blobs = len(self.ids), []
        tokens = np.zeros((3, count), np.int64)
        if self.segments:
            segment, place = np.concatenate(self.segments, axis=1)
            sizes, flat = np.concatenate(self.known.sizes, axis=1), np.concatenate(self.known.links)
            for k in range(3):
                tokens[k] = np.bincount(place, sizes[k][segment], count)
            n = sizes[2][segment]
            begins = np.cumsum(sizes[2]) - sizes[2]
            key = flat[np.repeat(begins[segment] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            part = (key >> 32) & (self.parts - 1)
            # radix partition, then B's token, then A's: the side of B is major
            keys, pair = np.unique(part << 52 | key, return_inverse=True)
            links, times = np.unique(pair.astype(np.int64) << 32 | np.repeat(place, n), return_counts=True)
            totals = np.bincount(pair, minlength=len(keys))
            part_of = keys >> 52
            blobs.append((-1, _packed(links, times)))
            for p in np.unique(part_of).tolist():
                here = slice(*np.searchsorted(part_of, [p, p + 1]).tolist())
                blobs.append((p, _packed(keys[here] & ((1 << 52) - 1), totals[here])))
        empty, none = [None] * len(blobs), [None] * count
        columns = (
            [self.number] * (count + len(blobs)), [*range(count), *empty], self.ids + empty,
            *[t.tolist() + empty for t in (*tokens, tokens[2])], self.groups + empty, none + [p for p, _ in blobs], none + [x for _, x in blobs],
        )
        return dict(zip(names, columns))


def aligned(
    df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    run_links: int = RUN_LINKS, parts: int = PARTS,
) -> DataFrame:
    """Document rows (doc_id, n_a, n_b, n_groups, n_links, groups), in runs (run, place), and the runs' links
    (part, blob). `groups` reads `a1,a2|b1;a3|b2,b3`. `parts` is a power of two. Nothing is shuffled."""
    schema = to_arrow_schema(schema_of(PLACED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        known = _Known(aligner)
        now = _Run(number, known, parts)
        for batch in small(batches):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low in range(0, len(texts), TOGETHER):
                now.add(doc_ids[low : low + TOGETHER], texts[low : low + TOGETHER])
                if now.links >= run_links:
                    yield pa.RecordBatch.from_pydict(now.rows(schema.names), schema=schema)
                    number += 1
                    if len(known.number) > SEGMENTS:
                        known = _Known(aligner)
                    now = _Run(number, known, parts)
        if now.ids:
            yield pa.RecordBatch.from_pydict(now.rows(schema.names), schema=schema)

    source = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return bounded(source).mapInArrow(run, schema_of(PLACED))


COUNTED = "run bigint, part int, blob binary"


def _merged(part: int, runs: list[int], blobs: list[bytes]) -> Iterator[dict]:
    """The counts of one radix partition, for every run in the order of its table: times 2, plus 1 for a B token's highest."""
    back = [np.empty(0, np.int64)] * len(runs)

    def entries(r: int):
        keys, totals = _unpacked(blobs[r], 1)
        back[r] = np.empty(len(keys), np.int64)
        for i, (k, n) in enumerate(zip(keys.tolist(), totals.tolist())):
            yield k, r, i, n

    token, pairs = -1, []  # the pairs of B's token: (count, [(run, place in its table)])

    def settle():
        best = max((p[0] for p in pairs), default=0)
        for count, users in pairs:
            code = 2 * count + (count == best)
            for r, i in users:
                back[r][i] = code

    last = -1
    for k, r, i, n in heapq.merge(*[entries(r) for r in range(len(runs))]):
        if k != last:
            if k >> 32 != token:
                settle()
                token, pairs = k >> 32, []
            pairs.append([0, []])
            last = k
        pairs[-1][0] += n
        pairs[-1][1].append((r, i))
    settle()
    for r, codes in zip(runs, back):
        yield {"run": r, "part": part, "blob": zstandard.compress(codes.tobytes(), 1)}


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])
    part, runs, blobs = None, [], []

    def out():
        rows = list(_merged(part, runs, blobs))
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for p, r, blob in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if p != part:
                if runs:
                    yield out()
                part, runs, blobs = p, [], []
            runs.append(r)
            blobs.append(blob)
    if runs:
        yield out()


def _add_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, part, blob) in order: the links of a run, then the counts of its radix partitions."""
    schema = pa.schema([("run", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    now, links, counts = None, b"", []

    def out():
        codes = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in counts])
        key, times = _unpacked(links, 1)
        code, place, times = codes[key >> 32], key & 0xFFFFFFFF, times.astype(np.int64)
        order = np.argsort(place, kind="stable")
        places, begins = np.unique(place[order], return_index=True)
        best = np.add.reduceat((times * (code & 1))[order], begins)
        total = np.add.reduceat((times * (code >> 1))[order], begins)
        return pa.RecordBatch.from_pydict(
            {"run": np.full(len(places), now), "place": places.astype(np.int32), "n_best": best, "count_sum": total}, schema=schema
        )

    for batch in batches:
        for r, p, blob in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if p == -1:
                if now is not None:
                    yield out()
                now, links, counts = r, blob, []
            else:
                counts.append(blob)
    if now is not None:
        yield out()


def with_counts(placed: DataFrame) -> DataFrame:
    """The document rows of aligned(), whatever their columns, with n_best (links whose count is the highest of
    their B token in the corpus) and count_sum (of the counts of all links)."""
    placed = staged(placed, "token-runs")
    tables = placed.where("part >= 0").select("part", "run", "blob")
    merged = bounded(tables.repartition("part").sortWithinPartitions("part", "run")).mapInArrow(_merge_task, COUNTED)
    links = placed.where("part = -1").select("run", "part", "blob")
    gathered = links.unionByName(merged).repartition("run").sortWithinPartitions("run", "part")
    sums = bounded(gathered).mapInArrow(_add_task, "run bigint, place int, n_best bigint, count_sum bigint")
    documents = placed.where("part is null").drop("part", "blob")
    return documents.join(sums, ["run", "place"], "left").fillna(0, ["n_best", "count_sum"]).drop("run", "place")
