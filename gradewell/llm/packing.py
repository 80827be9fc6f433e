"""Best-fit packing of tokenized documents into sequences of fixed capacity.

A document is its token ids followed by id 0. One longer than the capacity is
cut into full pieces and a rest. Pieces are placed by large-item matching: a
sequence holds at most two pieces longer than a third of the capacity, so these
are matched greedily (the longest with the longest that still fits); shorter
ones then go, longest first, where they leave the least room.

What is planned is the histogram of lengths, at most `capacity` numbers however
many pieces there are. The plan says for every length which ranks go to which
sequence, in ranges; pieces get a rank among those of their length by counting
salted groups, and look their place up. No task sees all pieces of a length.

Defined results: null or empty text is a document of one token (id 0); repeated
rows, and rows without an id, are documents of their own; an empty table gives
no rows; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import Cache, arrow_rows
from gradewell.workspace import staged

# Pieces of one length that are ranked together.
RANK_GROUP = 50_000
# Words whose ids a task keeps.
KNOWN_WORDS = 500_000
# Characters that Python's split() takes for spaces and the tokenizer does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
# Up to here, letters, numbers and lower case are the same for Python and the tokenizer.
LATIN = 0x250
END_OF_WORD = b"\xff"  # a byte that no text has
# How the tokenizer that the fast way below knows prepares a text.
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _fast_words(spec: dict):
    """word -> ids for Latin words, None if the tokenizer is not of the known kind.

    Byte pairs are merged by the rank of what they make. That is the same as merging
    by the list of pairs where every entry can be reached from its own characters
    and entries are numbered in the order of the list; both are checked.
    """
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    known = (
        model["type"] == "BPE" and suffix and (spec["normalizer"] or {}).get("normalizers") == STEPS
        and [p.get("pattern") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])] == [{"Regex": SPLIT}, None]
    )
    if not known:
        return None
    import tiktoken

    names = _byte_names()

    def raw(piece: str) -> bytes:
        bare = piece.removesuffix(suffix)
        return bytes(names[c] for c in bare) + (END_OF_WORD if bare != piece else b"")

    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {raw(piece): rank for piece, rank in model["vocab"].items() if piece not in special}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [ranks[raw(a + b)] for a, b in pairs]
    if made != sorted(made) or any(r >= made[0] for b, r in ranks.items() if len(b.removesuffix(END_OF_WORD)) == 1):
        return None
    merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    kind = [unicodedata.category(chr(c))[0] for c in range(LATIN)]
    letters, numbers = (re.escape("".join(chr(c) for c in range(LATIN) if kind[c] == k)) for k in "LN")
    pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall

    def ids(word: str) -> list[int]:
        found: list[int] = []
        for piece in [word] if word.isascii() and word.isalpha() else pieces(word):
            found += merge(piece.encode() + END_OF_WORD)
        return found

    return ids


def _every_entry_reached(spec: dict) -> bool:
    """Do the merges make every entry of the vocabulary out of its own characters?"""
    from tokenizers import models

    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix:
        return False
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    inside, final = models.BPE(model["vocab"], merges), models.BPE(model["vocab"], merges, end_of_word_suffix=suffix)
    special = {t["content"] for t in spec["added_tokens"]}

    def reached(piece: str, rank: int) -> bool:
        found = final.tokenize(piece.removesuffix(suffix)) if piece.endswith(suffix) else inside.tokenize(piece)
        return [t.id for t in found] == [rank]

    return all(piece in special or reached(piece, rank) for piece, rank in model["vocab"].items())


def _encoder(tokenizer_json: str, allow_fast: bool = True):
    """text -> little-endian ids.

    The tokenizer drops white space and never joins across it, so the ids of
    words, kept in a look-up, make up those of a text. Latin words go the fast way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    spec = json.loads(tokenizer_json)
    fast, special = _fast_words(spec) if allow_fast else None, [t["content"] for t in spec["added_tokens"]]
    latin = re.compile(f"[\\x00-{chr(LATIN - 1)}]*").fullmatch

    def plain(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word_ids(word: str) -> bytes:
        lower = word.lower()
        if latin(word) and latin(lower) and not any(s in word for s in special):
            return array("I", fast(lower)).tobytes()
        return plain(word)

    known = Cache(word_ids, KNOWN_WORDS)

    def encode(text: str) -> bytes:
        if fast is None or any(c in text for c in NOT_SPACE):
            return plain(text)
        return b"".join(map(known.__getitem__, text.split()))

    return encode


def token_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]): every document's tokens
    and the id 0 after them, cut into pieces of at most `capacity`."""
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    allow_fast = _every_entry_reached(json.loads(tokenizer_json))

    def task():
        encode = _encoder(tokenizer_json, allow_fast)

        def rows(batch: pa.RecordBatch) -> dict:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode(text or "") + b"\0\0\0\0"
                for k, first in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[first : first + 4 * capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(first // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = {"doc_id": pc.take(batch.column(0), pa.array(at, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
            return out | ({"ids": ids} if with_ids else {})

        return rows

    source = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return arrow_rows(source, task, schema)


@dataclass
class Slot:
    """Pieces of `length` with ranks from `rank` on: `copies` go into each of the
    `bins` sequences from `sequence` on, from `offset` on."""

    length: int
    rank: int
    sequence: int
    bins: int
    copies: int
    offset: int


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Places for `counts[length]` pieces of every length; (slots, number of sequences).

    Sequences filled alike are handled as one range, so the work follows the
    number of different lengths and not the number of pieces.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    rank = [0] * (capacity + 1)
    slots: list[Slot] = []
    sequences = 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)

    def put(length: int, first: int, bins: int, copies: int, offset: int, pieces: int) -> None:
        slots.append(Slot(length, rank[length], first, bins, copies, offset))
        rank[length] += pieces
        left[length] -= pieces

    smallest_large = capacity // 3 + 1
    for length in range(capacity, smallest_large - 1, -1):
        mate = min(length, capacity - length)
        while left[length]:
            while mate >= smallest_large and not left[mate]:
                mate -= 1
            if mate < smallest_large or (mate == length and left[length] == 1):
                if mate == length:  # one piece remains: the next shorter one may join it
                    mate -= 1
                    continue
                n = left[length]
                put(length, sequences, n, 1, 0, n)
                gaps[capacity - length].append((sequences, n))
            elif mate == length:
                n = left[length] // 2
                put(length, sequences, n, 2, 0, 2 * n)
                gaps[capacity - 2 * length].append((sequences, n))
            else:
                n = min(left[length], left[mate])
                put(length, sequences, n, 1, 0, n)
                put(mate, sequences, n, 1, length, n)
                gaps[capacity - length - mate].append((sequences, n))
            sequences += n
    for length in range(smallest_large - 1, 0, -1):
        room = length
        while left[length]:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                n = -(-left[length] // each)
                gaps[capacity].append((sequences, n))
                sequences += n
                room = capacity
            first, bins = gaps[room].pop()
            each = min(room // length, left[length])
            n = min(bins, left[length] // each)
            if n < bins:
                gaps[room].append((first + n, bins - n))
            put(length, first, n, each, capacity - room, n * each)
            gaps[room - each * length].append((first, n))
    return slots, sequences


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (kept by the caller, so that
    reading it twice gives the same rows)."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, _ = plan_packing(counts, capacity)
    slots.sort(key=lambda s: (s.length, s.rank))
    base = np.int64(1 << 44)
    first = np.array([s.length * base + s.rank for s in slots], np.int64)
    table = np.array([(s.rank, s.sequence, s.copies, s.offset) for s in slots], np.int64).reshape(-1, 4)

    # Ranks among pieces of one length: groups by salt, counted, and numbered one after another.
    spark = pieces.sparkSession
    groups = [(length, -(-n // RANK_GROUP)) for length, n in counts.items()]
    salts = F.broadcast(spark.createDataFrame(groups, "length bigint, salts bigint"))
    key = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salted = pieces.join(salts, "length").withColumn("salt", F.expr(f"pmod(xxhash64({', '.join(key)}), salts)")).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy(*key)
    ranked = (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(sizes, ["length", "salt"])
        .withColumn("rank", col("rank") + col("before"))
        .select(*pieces.columns, "rank")
    )
    names = pieces.columns

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            start, sequence, copies, offset = table[np.searchsorted(first, length * base + rank, "right") - 1].T
            nth = rank - start
            return {c: batch.column(c) for c in names} | {"sequence_id": sequence + nth // copies, "offset": offset + nth % copies * length}

        return rows

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return arrow_rows(ranked, task, f"{kinds}, sequence_id bigint, offset bigint")


def pack(
    df: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece with its sequence and the place in it."""
    return place(staged(token_pieces(df, tokenizer_path, capacity, id_col, text_col, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids, lengths) from pieces packed with their ids: the training rows themselves."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # at most `capacity` tokens in all
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.length").alias("lengths")
    )
