"""Substring dedup of paragraphs and of passages inside them.

Paragraphs are lines of at least `LEAST_WORDS` words, and shorter lines joined
with their short neighbours: up to the next blank line, and past blank lines up
to the next long line. Distinct paragraphs get
MinHash signatures of their five-word shingles, banded for high recall (7 bands
of 3 at a similarity of 0.8 find 99.3 % of the pairs, and nearly all above);
paragraphs that collide are verified by their exact Jaccard similarity and
joined to components.

A passage may also sit inside a longer paragraph. Paragraphs are therefore also
cut into pieces of 5 to about 20 words where the hash of the words at the cut is
the smallest within four words: the cuts inside a passage depend on its own
words alone, so its inner pieces come out equal wherever it stands. Pieces are
grouped by all their shingles (similarity 1).

Of every component the first unit stays (by document id, then text hash, then
place) and the others are removed. Around units that follow each other in both
texts, the words of the text and of the one that keeps their first copies are
aligned, over up to `SKIP` changed words at a time: stretches whose exact Jaccard
similarity reaches the threshold are units too, and so are their equal parts
where it does not. Near copies are thus found inside longer lines. Removed units of a document that touch are
one span; a span must have `LEAST_SPAN` words, so short common phrases stay.

Defined results: texts without words give nothing; a null id counts as the
largest; rows equal in id and text are one document and are cut alike; columns
besides the id and the text are not looked at, and are returned unchanged by
`cut_documents` (a column n_chars is set to the new length); a document that
loses all its words is removed; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import LOWER, arrow_rows, chunks, mix, multipliers, raw_texts, schema_of, shingle_hashes, small
from gradewell.llm.graph import bucket_links, components
from gradewell.workspace import attach, discard, staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 7, 3
LEAST_SPAN = 15  # words of a span that is removed
LEAST_WORDS = LEAST_SPAN  # of a paragraph
GAP = 30  # words between units that are aligned together
AROUND = 40  # words before and after them that are looked at
SKIP = 3  # words of a change that alignment passes over
REACH = 4  # words on each side that a cut is compared with
BITS = 512  # of the sets of shingles that are compared first
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of all texts: text, first byte, byte after the last, and a number that differs from line to line."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return _places(buffer, SPACES[buffer], texts)


def _places(buffer: np.ndarray, space: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    before = np.r_[True, space[:-1]]
    first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    begin = np.cumsum([0, *(len(raw) + 1 for raw in texts)])
    text = np.searchsorted(begin, first, "right") - 1
    line = np.searchsorted(np.flatnonzero(buffer == 10), first)
    return text, first - begin[text], last - begin[text], line


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and its place as word_places gives it. Words that are alike are hashed once."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
    space = SPACES[buffer]
    places = _places(buffer, space, texts)
    ends = np.r_[0, np.cumsum(places[2] - places[1])].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(buffer[~space])])
    words = words.dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[words.indices.to_numpy()], *places


def _listed(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of every entry of the lists, the entries)."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.values.slice(ends[0], ends[-1] - ends[0])


def _lists(sizes: np.ndarray, values, none: np.ndarray | None = None) -> pa.ListArray:
    """Lists of these sizes, null (and of size 0) where `none` says so."""
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=None if none is None else pa.array(none))


def cut_points(words: np.ndarray, line: np.ndarray) -> np.ndarray:
    """True where a piece begins: at the first word of a line, and at inner words
    whose hash (with the next word) is smallest within REACH words of the line."""
    n = len(words)
    same = np.r_[line[1:] == line[:-1], False]
    value = mix(words + np.where(same, np.r_[words[1:], words[:1]], np.uint64(0)) * np.uint64(3))
    good = np.ones(n, bool)
    for k in range(1, REACH + 1):
        together = line[k:] == line[:-k]
        good[k:] &= ~together | (value[k:] < value[:-k])
        good[:-k] &= ~together | (value[:-k] <= value[k:])
    for k in range(1, SHINGLE + 1):  # no piece at either end of a line shorter than a shingle
        inside = np.zeros(n, bool)
        inside[k:] = line[k:] == line[:-k]
        good &= inside
        if k < SHINGLE:
            follows = np.zeros(n, bool)
            follows[:-k] = line[k:] == line[:-k]
            good &= follows
    return good | np.r_[True, line[1:] != line[:-1]][:n]


def paragraph_starts(text: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines begin, where lines joined with short neighbours up to a blank line do, and where those joined past blank lines do."""
    new_line = np.r_[True, line[1:] != line[:-1]]
    begin = np.flatnonzero(new_line)
    short = np.diff(np.r_[begin, len(line)]) < LEAST_WORDS
    past = np.r_[True, ~(short[1:] & short[:-1]) | (text[begin[1:]] != text[begin[:-1]])]
    blank = np.r_[True, np.diff(line[begin]) > 1]
    return begin, begin[past | blank], begin[past]


def _unit_shingles(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of units of at least SHINGLE words one after another, where each unit's begin)."""
    full = shingle_hashes(words, SHINGLE)
    count = size - SHINGLE + 1
    offset = np.cumsum(np.r_[0, count[:-1]])
    at = np.arange(count.sum()) - np.repeat(offset, count) + np.repeat(begin, count)
    return full[at], offset


DOCUMENT = ["doc_id", "text_hash", "more"]
# A unit's bytes are start << 32 | stop, its place first word << 32 | words << 2 | kind.
UNITS = "key bigint, doc_id bigint, text_hash bigint, more bigint, span bigint, place bigint, bands array<bigint>"
PIECE, LINE, WHOLE = 0, 1, 2


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts, paragraphs (with bands, the others have none) and pieces of every text."""
    factors = multipliers(BANDS * ROWS)

    def task():
        def rows(batch: pa.RecordBatch) -> dict | None:
            texts = raw_texts(batch.column(3))
            whole_keys = mix(batch.column(1).to_numpy().view(np.uint64) ^ mix(batch.column(2).to_numpy().view(np.uint64)))
            out: dict[str, list] = {name: [] for name in ("key", "row", "span", "place")}
            bands_of = []

            def add(key, row, start, stop, at, words, kind):
                out["key"].append(key.view(np.int64))
                out["row"].append(row)
                out["span"].append(start << 32 | stop)
                out["place"].append(at << 32 | words << 2 | kind)

            for low, high in chunks(texts):
                words, text, first, last, line = hashed_words(texts[low:high])
                if not len(words):
                    continue
                place = np.arange(len(words)) - np.searchsorted(text, text)  # of a word among those of its text
                begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                size = np.diff(np.r_[begin, len(words)])
                begin, size = begin[size >= LEAST_SPAN], size[size >= LEAST_SPAN]
                if len(begin):
                    row = low + text[begin]
                    add(whole_keys[row], row, first[begin], last[begin + size - 1], place[begin], size, WHOLE)
                    bands_of.append(pa.nulls(len(begin), pa.list_(pa.int64())))
                cuts = [np.flatnonzero(cut_points(words, by)) for by in (line, text)]
                for kind, least, begins in ((LINE, LEAST_WORDS, paragraph_starts(text, line)), (PIECE, SHINGLE, cuts)):
                    found = np.unique(np.concatenate([b << 32 | np.diff(np.r_[b, len(words)]) for b in begins]))
                    begin, size = found >> 32, found & 0xFFFFFFFF
                    enough = size >= least
                    begin, size = begin[enough], size[enough]
                    if not len(begin):
                        continue
                    shingles, offset = _unit_shingles(words, begin, size)
                    key = mix(np.add.reduceat(mix(shingles), offset) + np.uint64(kind == LINE))
                    add(key, low + text[begin], first[begin], last[begin + size - 1], place[begin], size, kind)
                    if kind == LINE:
                        minima = np.stack([np.minimum.reduceat(shingles * f, offset) for f in factors], 1)
                        bands = np.zeros((len(begin), BANDS), np.uint64)
                        for r in range(ROWS):
                            bands = mix(bands + minima[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                        flat = pa.array(bands.view(np.int64).reshape(-1))
                        bands_of.append(pa.ListArray.from_arrays(np.arange(len(begin) + 1, dtype=np.int32) * BANDS, flat))
                    else:
                        bands_of.append(pa.nulls(len(begin), pa.list_(pa.int64())))
            if not bands_of:
                return None
            joined = {k: np.concatenate(v) for k, v in out.items()}
            at = pa.array(joined["row"])
            document = {name: pc.take(batch.column(i), at) for i, name in enumerate(DOCUMENT)}
            return {"key": joined["key"], **document, "span": joined["span"], "place": joined["place"], "bands": pa.concat_arrays(bands_of)}

        return rows

    return arrow_rows(_documents(df, id_col, text_col), task, UNITS)


def text_hashes(text: Column) -> list[Column]:
    """128 bits that tell texts under the same id apart."""
    return [F.xxhash64(text), F.xxhash64(F.lit("more"), text)]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    one, two = text_hashes(text)
    return df.select(col(id_col).cast("bigint").alias("doc_id"), one.alias("text_hash"), two.alias("more"), text.alias("text"))


def _unpacked() -> list[Column]:
    return [F.expr(x) for x in (
        "shiftright(span, 32) as start", "span & 4294967295 as stop", "shiftright(place, 32) as at",
        "shiftright(place & 4294967295, 2) as words", "cast(place & 3 as int) as kind",
    )]


def _line_components(lines: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(key, component) of the distinct paragraphs that are similar to another one."""
    banded = lines.select("key", "bands").distinct().select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where(col("least") < col("most")).select("band")
    banded = staged(banded.join(shared, "band"), "bands")
    # One occurrence of every paragraph that collides, to read its text.
    wanted = lines.join(banded.select("key").distinct(), "key").groupBy("key").agg(
        F.min(F.struct(*DOCUMENT, "span")).alias("at")
    ).select("key", "at.*")
    spans = wanted.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("key", "span")).alias("spans"))
    found = _with_text(docs, spans)

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            texts = raw_texts(batch.column(0))
            row, places = _listed(batch.column(1))
            parts = [texts[i][p >> 32 : p & 0xFFFFFFFF] for i, p in zip(row.tolist(), places.field("span").to_numpy().tolist())]
            sets, sizes = [], []
            for low, high in chunks(parts):
                words, text, *_ = hashed_words(parts[low:high])
                size = np.bincount(text, minlength=high - low)
                shingles, _ = _unit_shingles(words, np.cumsum(np.r_[0, size[:-1]]), size)
                owner = np.repeat(np.arange(high - low), size - SHINGLE + 1)
                order = np.lexsort((shingles, owner))
                shingles, owner = shingles[order], owner[order]
                new = np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])]
                sets.append(shingles[new].view(np.int64))
                sizes.append(np.bincount(owner[new], minlength=high - low))
            return {"key": places.field("key"), "shingles": _lists(np.concatenate(sizes), np.concatenate(sets))}

        return rows

    # One row per key: `wanted` names one place of each, and equal rows of a document give equal sets.
    shingles = staged(arrow_rows(found.select("text", "spans"), task, "key bigint, shingles array<bigint>"), "shingles")
    members = banded.join(shingles.dropDuplicates(["key"]), "key")

    def accept(table: pa.Table):
        lists = table.column("shingles").combine_chunks()
        values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        values, ends = values[ends[0] : ends[-1]], ends - ends[0]
        size = np.diff(ends)
        # One bit for every shingle, of BITS: a bit that only one of two sets has is at least one shingle that only it has.
        bits = np.zeros((len(size), BITS // 64), np.uint64)
        place = (np.repeat(np.arange(len(size)), size), (values >> np.uint64(6)) % np.uint64(BITS // 64))
        np.bitwise_or.at(bits, place, np.uint64(1) << (values & np.uint64(63)))
        sets: dict[int, frozenset] = {}

        def set_of(k: int) -> frozenset:
            if k not in sets:
                sets[k] = frozenset(values[ends[k] : ends[k + 1]].tolist())
            return sets[k]

        def similar(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            good = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            at = np.flatnonzero(good)
            one, two = bits[i[at]], bits[j[at]]
            most = np.minimum(size[i[at]] - np.bitwise_count(one & ~two).sum(1), size[j[at]] - np.bitwise_count(two & ~one).sum(1))
            good[at] = most >= threshold * (size[i[at]] + size[j[at]] - most)
            for k in np.flatnonzero(good):
                a, b = set_of(int(i[k])), set_of(int(j[k]))
                both = len(a & b)
                good[k] = both >= threshold * (len(a) + len(b) - both)
            return good

        return similar

    links = bucket_links(members, ["band"], "key", accept, "key bigint, shingles array<bigint>")
    found = staged(components(links, "paragraphs").select(col("node").alias("key"), "component"), "classes")
    discard(banded, shingles)
    return found


def _same_document(left: str, right: str) -> Column:
    return F.expr(f"{left}doc_id <=> {right}doc_id and {left}text_hash = {right}text_hash and {left}more = {right}more")


def _with_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts of the documents that `spans` (doc_id, text_hash, more, spans) names."""
    named = spans.select(*[col(c).alias(f"__{c}") for c in DOCUMENT], "spans")
    return docs.join(named, _same_document("", "__")).select(*DOCUMENT, "text", "spans")


def chains(follows: list[bool], at: list[int], kept_at: list[int], words: list[int]) -> tuple[list[int], list[int]]:
    """(units in chains, how many of these come before each chain): units of one text that follow each other, no further
    than GAP words apart, in the text that keeps their first copies as well. A unit that `follows` is of the same two texts
    as the one before it. Units that end inside the last one of their chain are left out."""
    units, begins, last = [], [], 0
    for i, same in enumerate(follows):
        if same:
            forward, kept_forward = at[i] - at[last], kept_at[i] - kept_at[last]
            if abs(forward - kept_forward) <= GAP and 0 <= kept_forward and max(forward, kept_forward) <= words[last] + GAP:
                if forward + words[i] > words[last]:
                    units.append(i)
                    last = i
                continue
        begins.append(len(units))
        units.append(i)
        last = i
    return units, begins


KEPT = ["kept", "kept_hash", "kept_more"]


def _equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common at their beginnings."""
    most, n, size = min(len(a), len(b)), 0, 16
    while n < most:
        other = np.flatnonzero(a[n : n + size] != b[n : n + size]) if min(most - n, size) == size else np.flatnonzero(a[n:most] != b[n:most])
        if len(other):
            return n + int(other[0])
        n, size = min(n + size, most), 4 * size
    return n


def _follow(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Equal stretches (place in a, place in b, words) from a[i] and b[j] on, with at most SKIP words of either between them."""
    out = []
    while True:
        n = _equal_words(a[i:], b[j:])
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        near, kept_near = a[i : i + SKIP + SHINGLE].tolist(), b[j : j + SKIP + SHINGLE].tolist()
        for x, y in STEPS:
            if len(near) - x >= SHINGLE and near[x : x + SHINGLE] == kept_near[y : y + SHINGLE]:
                i, j = i + x, j + y
                break
        else:
            return out


STEPS = sorted(((x, y) for x in range(SKIP + 1) for y in range(SKIP + 1) if x or y), key=lambda s: (max(s), sum(s)))


def similar_stretches(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], threshold: float) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) in the words a and b: stretches around the seeds (equal places) that reach the threshold."""
    out: list[tuple[int, int, int, int]] = []
    a, b = (np.asarray(x, np.int64) for x in (a, b))

    def take(parts: list[tuple[int, int, int]]) -> None:
        (i, j, _), (p, q, n) = parts[0], parts[-1]
        if len(parts) > 1:
            x, y = (np.unique(shingle_hashes(part.view(np.uint64), SHINGLE)) for part in (a[i : p + n], b[j : q + n]))
            both = len(np.intersect1d(x, y, True))
            if not both or both < threshold * (len(x) + len(y) - both):
                take(parts[: len(parts) // 2])
                take(parts[len(parts) // 2 :])
                return
        out.append((i, p + n, j, q + n))

    done = done_b = 0
    for i, j in seeds:
        if i < done:
            continue
        back = _follow(a[done:i][::-1], b[min(done_b, j) : j][::-1], 0, 0)
        if back and back[0][:2] == (0, 0):  # goes on in the stretch from the seed
            i, j = i - back[0][2], j - back[0][2]
            back = [(x - back[0][2], y - back[0][2], n) for x, y, n in back[1:]]
        parts = [(i - x - n, j - y - n, n) for x, y, n in reversed(back)] + _follow(a, b, i, j)
        if not parts:
            continue
        take(parts)
        done, done_b = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
    return [r for r in out if r[1] - r[0] >= SHINGLE]


SEEDS = "array<struct<at: int, kept_at: int>>"
WINDOW = (
    "doc_id bigint, text_hash bigint, more bigint, low int, high int, kept bigint, kept_hash bigint, kept_more bigint, "
    f"kept_low int, kept_high int, component bigint, anchor int, anchor_byte int, kept_anchor int, kept_byte int, seeds {SEEDS}"
)
ALIGNED = "doc_id bigint, text_hash bigint, more bigint, start bigint, stop bigint, at bigint, words bigint, component bigint, kept bigint"


def region(raw: bytes, anchor: int, before: int, after: int) -> tuple[int, int]:
    """The bytes of `before` words that end ahead of byte `anchor` and `after` words from there on, or all there are."""
    head, tail = raw[:anchor].rsplit(None, before) if before else [raw[:anchor]], raw[anchor:].split(None, after)
    low = len(head[0]) if len(head) > before else 0
    return low, len(raw) - len(tail[after]) if len(tail) > after else len(raw)


def _aligned(copies: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Units around these pieces that are similar to the text that keeps their first copies."""
    columns = [f.name for f in schema_of(WINDOW)]
    unit = F.struct("at", "start", "words", "component", *KEPT, "kept_at", "kept_start")
    lists = copies.groupBy(*DOCUMENT).agg(F.collect_list(unit).alias("units"))

    def chain():
        def rows(batch: pa.RecordBatch) -> dict:
            row, units = _listed(batch.column(3))
            none = units.field("kept").is_null().to_numpy(zero_copy_only=False)
            numbers = {f.name: units.field(f.name).fill_null(0).to_numpy() for f in units.type}
            texts = (*(numbers[k] for k in reversed(KEPT)), none, row)
            order = np.lexsort((-numbers["words"], numbers["at"], *texts))
            follows = np.r_[False, np.all([x[order][1:] == x[order][:-1] for x in texts], axis=0)]
            members, begins = chains(follows.tolist(), *(numbers[k][order].tolist() for k in ("at", "kept_at", "words")))
            members, begins = order[members], np.array(begins)
            one = {k: x[members] for k, x in numbers.items()}
            first = members[begins]
            seeds = pa.StructArray.from_arrays([pa.array(one[k].astype(np.int32)) for k in ("at", "kept_at")], ["at", "kept_at"])
            sizes = np.diff(np.r_[begins, len(members)])
            at, kept_at = numbers["at"][first], numbers["kept_at"][first]
            return {name: pc.take(batch.column(k), pa.array(row[first])) for k, name in enumerate(DOCUMENT)} | {
                "low": np.maximum(0, at - AROUND), "high": np.maximum.reduceat(one["at"] + one["words"], begins) + AROUND,
                **{k: pc.take(units.field(k), pa.array(first)) for k in KEPT},
                "kept_low": np.maximum(0, kept_at - AROUND),
                "kept_high": np.maximum.reduceat(one["kept_at"] + one["words"], begins) + AROUND,
                "component": numbers["component"][first], "anchor": at, "anchor_byte": numbers["start"][first],
                "kept_anchor": kept_at, "kept_byte": numbers["kept_start"][first], "seeds": _lists(sizes, seeds),
            }

        return rows

    windows = staged(arrow_rows(lists, chain, WINDOW), "chains")
    # One pass over the texts reads the words of both sides; a window that many texts share is read once.
    here = [col(k).alias(c) for k, c in zip([*KEPT, "kept_low", "kept_high"], [*DOCUMENT, "low", "high"])]
    kept = windows.groupBy(*here).agg(F.min(F.struct("kept_anchor", "kept_byte")).alias("a")).select(
        *DOCUMENT, "low", "high", col("a")["kept_anchor"].alias("anchor"), col("a")["kept_byte"].alias("anchor_byte")
    )
    asked = windows.unionByName(kept, allowMissingColumns=True)
    rest = [c for c in columns[3:] if c not in ("kept_anchor", "kept_byte")]
    spans = asked.groupBy(*DOCUMENT).agg(F.collect_list(F.struct(*rest)).alias("spans"))
    rest = [c for c in rest if c not in ("anchor", "anchor_byte")]

    def read():
        def rows(batch: pa.RecordBatch) -> dict:
            texts = raw_texts(batch.column(3))
            row, wanted = _listed(batch.column(4))
            own = wanted.field("seeds").is_valid().to_numpy(zero_copy_only=False)
            asked = zip(row.tolist(), *(wanted.field(k).to_numpy().tolist() for k in ("low", "high", "anchor", "anchor_byte")))
            regions = [(i, *region(texts[i], byte, anchor - low, high - anchor)) for i, low, high, anchor, byte in asked]
            parts = [texts[i][low:high] for i, low, high in regions]
            hashes, first, last, sizes = [], [], [], []
            for low, high in chunks(parts):
                words, text, begin, end, _ = hashed_words(parts[low:high])
                ahead = np.array([r[1] for r in regions[low:high]])[text]
                mine = own[low:high][text]
                hashes.append(words.view(np.int64))
                first.append((begin + ahead)[mine].astype(np.int32))
                last.append((end + ahead)[mine].astype(np.int32))
                sizes.append(np.bincount(text, minlength=high - low))
            sizes = np.concatenate(sizes)
            at = pa.array(row)
            return {name: pc.take(batch.column(k), at) for k, name in enumerate(DOCUMENT)} | {k: wanted.field(k) for k in rest} | {
                "hashes": _lists(sizes, np.concatenate(hashes)),
                "starts": _lists(sizes * own, np.concatenate(first), ~own), "stops": _lists(sizes * own, np.concatenate(last), ~own),
            }

        return rows

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema_of(WINDOW) if f.name in (*DOCUMENT, *rest)])
    schema = f"{schema}, hashes array<bigint>, starts array<int>, stops array<int>"
    words = staged(arrow_rows(_with_text(docs, spans), read, schema), "windows")
    discard(windows)
    other = words.where(col("seeds").isNull()).select(
        *[col(c).alias(k) for k, c in zip(KEPT, DOCUMENT)], col("low").alias("kept_low"), col("high").alias("kept_high"),
        col("hashes").alias("kept_hashes"),
    )
    pairs = attach(words.where(col("seeds").isNotNull()), other, [*KEPT, "kept_low", "kept_high"])

    def align():
        def rows(batch: pa.RecordBatch) -> dict:
            ends = {k: batch.column(k).offsets.to_numpy() for k in ("hashes", "kept_hashes", "starts", "stops", "seeds")}
            words = {k: batch.column(k).values.to_numpy() for k in ("hashes", "kept_hashes", "starts", "stops")}
            places = [batch.column("seeds").values.field(k).to_numpy() for k in ("at", "kept_at")]
            low, kept_low = (batch.column(k).to_numpy().astype(np.int64) for k in ("low", "kept_low"))
            one_text = [x == y for x, y in zip(*(zip(*(batch.column(c).to_pylist() for c in names)) for names in (DOCUMENT, KEPT)))]
            found = []
            for i, same in enumerate(one_text):
                own, other = (words[k][ends[k][i] : ends[k][i + 1]] for k in ("hashes", "kept_hashes"))
                seeds = [(x[ends["seeds"][i] : ends["seeds"][i + 1]] - y[i]).tolist() for x, y in zip(places, (low, kept_low))]
                for a, b, _, kept_b in similar_stretches(own, other, list(zip(*seeds)), threshold):
                    if same and kept_b + kept_low[i] > a + low[i]:
                        continue  # what stays may not be part of what goes
                    found.append((i, a, b))
            i, a, b = np.array(found, np.int64).reshape(-1, 3).T
            row = pa.array(i)
            return {name: pc.take(batch.column(name), row) for name in (*DOCUMENT, "component", "kept")} | {
                "start": words["starts"][ends["starts"][i] + a], "stop": words["stops"][ends["stops"][i] + b - 1],
                "at": a + low[i], "words": b - a,
            }

        return rows

    names = [*DOCUMENT, "low", *KEPT, "kept_low", "component", "seeds", "hashes", "starts", "stops", "kept_hashes"]
    return arrow_rows(pairs.select(*names), align, ALIGNED)


def _first(members: DataFrame, group: str) -> DataFrame:
    """(group, first): the unit of every group that stays."""
    order = F.struct(col("doc_id").isNull().alias("none"), *DOCUMENT, "place", "span")
    return staged(members.groupBy(group).agg(F.min(order).alias("first")), "first")


def _copies(members: DataFrame, group: str, name: str) -> DataFrame:
    """The units that go, with the one that stays, staged; the rows of a large group are not shuffled."""
    first = _first(members, group)
    here = attach(members, first, [group])
    at, size = F.expr("shiftright(first.place, 32)"), F.expr("shiftright(first.place & 4294967295, 2)")
    # Units of one text may overlap: what shares words with the first stays.
    stays = _same_document("", "first.") & (F.shiftright("place", 32) < at + size)
    copies = here.where(~stays).select(
        *DOCUMENT, *_unpacked(), "component", F.col("first.doc_id").alias("kept"), F.col("first.text_hash").alias("kept_hash"),
        F.col("first.more").alias("kept_more"), at.alias("kept_at"), F.expr("shiftright(first.span, 32)").alias("kept_start"), "key", "span", "place",
    )
    copies = staged(copies, name)
    discard(first)
    return copies


MEMBER = "key bigint, doc_id bigint, text_hash bigint, more bigint, span bigint, place bigint, component bigint"
UNCOVERED = f"{MEMBER}, kept bigint, kept_hash bigint, kept_more bigint"


def _uncovered(pieces: DataFrame, gone: DataFrame) -> DataFrame:
    """Removed texts and paragraphs (those inside a removed text left out) and the pieces that lie in none of them."""
    names = [f.name for f in schema_of(UNCOVERED)]
    rest = [n for n in names if n not in DOCUMENT]
    both = gone.select(*names).unionByName(pieces.select(*[f.name for f in schema_of(MEMBER)]), allowMissingColumns=True)
    lists = both.groupBy(*DOCUMENT).agg(F.collect_list(F.struct(*rest)).alias("units"))

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            at, units = batch.column(3), batch.column(3).values
            sizes = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            units = units.slice(at.offsets[0].as_py(), len(row))
            place = units.field("place").to_numpy()
            low, kind = place >> 32, place & 3
            high = low + ((place & 0xFFFFFFFF) >> 2)
            # Paragraphs count before pieces, whole texts before both; places of different documents do not meet.
            base = row.astype(np.int64) << 32
            keep = np.ones(len(row), bool)
            for above, below in ((WHOLE, (LINE, PIECE)), (LINE, (PIECE,))):
                cover = np.flatnonzero((kind == above) & keep)
                if not len(cover):
                    continue
                cover = cover[np.argsort(base[cover] + low[cover], kind="stable")]
                begins, reach = base[cover] + low[cover], np.maximum.accumulate(base[cover] + high[cover])
                apart = np.flatnonzero(np.r_[True, begins[1:] > reach[:-1]])
                begins, reach = begins[apart], reach[np.r_[apart[1:] - 1, len(cover) - 1]]
                inner = np.flatnonzero(np.isin(kind, below))
                slot = np.searchsorted(begins, base[inner] + low[inner], "right") - 1
                keep[inner] &= (slot < 0) | (base[inner] + high[inner] > reach[slot])
            chosen = pa.array(np.flatnonzero(keep))
            units, row = units.take(chosen), pa.array(row[keep])
            flat = {n: units.field(n) for n in rest}
            return {n: pc.take(batch.column(k), row) for k, n in enumerate(DOCUMENT)} | flat

        return rows

    return staged(arrow_rows(lists, task, UNCOVERED), "uncovered")


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least_words: int = LEAST_SPAN
) -> DataFrame:
    """(doc_id, text_hash, more, start, stop, n_words, component_id, kept_doc_id): the
    bytes [start, stop) of a text that repeat what stays elsewhere; kept_doc_id is the
    smallest document that keeps a unit of the span, component_id that unit's component."""
    docs = _documents(df, id_col, text_col)
    # Every table goes as soon as what follows from it is written: the tables of units are the largest.
    all_units = staged(units(df, id_col, text_col), "units")
    lines = all_units.where(col("bands").isNotNull())
    classes = _line_components(lines, docs, threshold)
    # Units that are not alone: texts, paragraphs and pieces with copies, and paragraphs with similar ones.
    repeated = all_units.groupBy("key").agg(F.count("*").alias("n")).where(col("n") > 1).select("key")
    named = repeated.join(classes, "key", "full_outer").select("key", F.coalesce("component", "key").alias("component"))
    named = staged(named, "named")  # so the join below may split the copies of one unit
    members = staged(all_units.drop("bands").join(named, "key"), "members")
    discard(all_units, classes, named)
    gone = _copies(members.where("place & 3 > 0"), "component", "gone")
    rest = _uncovered(members.where("place & 3 = 0"), gone)
    discard(members, gone)
    pieces = _copies(rest.where("place & 3 = 0").select(*[f.name for f in schema_of(MEMBER)]), "key", "pieces")
    whole = rest.where("place & 3 > 0").select("*", *_unpacked())
    names = [f.name for f in schema_of(ALIGNED)]
    found = whole.select(*names).unionByName(pieces.select(*names)).unionByName(_aligned(pieces, docs, threshold).select(*names))
    unit = F.struct("start", "stop", "at", "words", "component", "kept")
    per_doc = found.groupBy(*DOCUMENT).agg(F.collect_set(unit).alias("units"))

    def task():
        def rows(batch: pa.RecordBatch) -> dict:
            row, runs = merged(*_listed(batch.column(3)))
            long = pc.greater_equal(runs["n_words"], least_words)
            at = pa.array(row).filter(long)
            return {name: pc.take(batch.column(k), at) for k, name in enumerate(DOCUMENT)} | {k: x.filter(long) for k, x in runs.items()}

        return rows

    schema = "doc_id bigint, text_hash bigint, more bigint, start int, stop int, n_words bigint, component_id bigint, kept_doc_id bigint"
    return arrow_rows(per_doc, task, schema)


def merged(row: np.ndarray, units: pa.StructArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Units of one text (`row`) joined where no word lies between them; words that several units hold count once."""
    none = units.field("kept").is_null().to_numpy(zero_copy_only=False)
    start, stop, at, words, component, kept = (units.field(f.name).fill_null(0).to_numpy() for f in units.type)
    order = np.lexsort((kept, none, component, -words, at, row))
    begin = (row.astype(np.int64) << 32) + at  # places of different texts do not meet
    reach = np.r_[-1, np.maximum.accumulate((begin + words)[order])]
    more = reach[1:] > reach[:-1]  # the others lie inside those before them
    new = (begin[order] > reach[:-1])[more]
    order, run = order[more], np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(order)] - 1
    least = order[np.lexsort((kept[order], none[order], run))[first]]  # of every run the unit of the smallest kept document
    first, last = order[first], order[last]
    return row[first], {
        "start": pa.array(start[first]), "stop": pa.array(stop[last]), "n_words": pa.array(at[last] + words[last] - at[first]),
        "component_id": pa.array(component[least]), "kept_doc_id": pa.array(kept[least], mask=none[least]),
    }


def cut_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least_words: int = LEAST_SPAN
) -> DataFrame:
    """df without the repeated spans of its texts and without documents that are nothing else."""
    spans = repeated_spans(df, id_col, text_col, threshold, least_words)
    cuts = spans.groupBy(*[col(c).alias(f"__{c}") for c in DOCUMENT]).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    one, two = text_hashes(col(text_col).cast("string"))
    key = col(id_col).cast("bigint").eqNullSafe(col("__doc_id")) & (one == col("__text_hash")) & (two == col("__more"))
    joined = df.join(cuts, key, "left").select(*[col(c) for c in df.columns], "__spans")
    text_at, length_at = df.columns.index(text_col), df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            arrays, names = list(batch.columns[:-1]), batch.schema.names[:-1]
            spans = batch.column(batch.num_columns - 1)
            texts, keep = arrays[text_at].to_pylist(), [True] * batch.num_rows
            lengths = arrays[length_at].to_pylist() if length_at is not None else None
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                raw = texts[i].encode()
                for span in sorted(spans[int(i)].as_py(), key=lambda s: -s["start"]):
                    raw = raw[: span["start"]] + raw[span["stop"] :]
                texts[i] = raw.decode()
                keep[i] = bool(raw.split())
                if lengths is not None:
                    lengths[i] = len(texts[i])
            arrays[text_at] = pa.array(texts, arrays[text_at].type)
            if lengths is not None:
                arrays[length_at] = pa.array(lengths, arrays[length_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, df.schema)
