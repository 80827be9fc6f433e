import itertools
import re

import numpy as np
import odd
import pyarrow as pa
import pytest
import xxhash

from gradewell import workspace
from gradewell.llm import paragraphs
from gradewell.llm.paragraphs import cut_documents, cut_points, repeated_spans, similar_stretches, word_places
from gradewell.llm.queries import op10_paragraphs

SMALL = "/root/testdata/sf0.001"


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def prose(rng, n):
    return [("".join(rng.choice(list("abcdefghijklmnop"), 5))) for _ in range(n)]


def test_every_similar_paragraph_pair_loses_one(spark):
    """Brute force over all pairs of long lines: of two similar ones, at most one is left whole."""
    docs = dict(odd.table(SMALL, "documents", "doc_id, text"))
    spans = op10_paragraphs(spark, SMALL).collect()
    gone = {}
    for r in spans:
        gone.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    lines = []
    for d, text in docs.items():
        at = 0
        for line in text.encode().split(b"\n"):
            w = line.decode().split()
            if len(w) >= 20:
                lines.append((d, at, at + len(line.rstrip()), shingles([odd.lower(x) for x in w])))
            at += len(line) + 1
    similar = 0
    for a, b in itertools.combinations(lines, 2):
        if a[3] & b[3] and len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3]):
            similar += 1
            # all but a few leading bytes (white space) of one of them is removed
            assert any(s <= x[1] + 3 and x[2] <= e for x in (a, b) for s, e in gone.get(x[0], [])), (a[:3], b[:3])
    assert similar > 10
    for r in spans:
        assert r["n_words"] >= 15 and r["start"] < r["stop"] <= len(docs[r["doc_id"]].encode())


def test_passages_inside_other_text(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(20):
        passage = prose(rng, 60)
        for _ in range(3):
            texts.append(" ".join(prose(rng, int(rng.integers(30, 90))) + passage + prose(rng, int(rng.integers(30, 90)))))
    texts += [" ".join(prose(rng, 150)) for _ in range(40)]  # clean
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hit = {r["doc_id"]: r for r in repeated_spans(df).collect()}
    assert set(hit) == {i for i in range(60) if i % 3}
    assert all(r["kept_doc_id"] == i - i % 3 for i, r in hit.items())
    assert min(r["n_words"] for r in hit.values()) >= 25 and max(r["n_words"] for r in hit.values()) <= 60
    kept = {r["doc_id"]: r["text"] for r in cut_documents(df).collect()}
    assert all(kept[i] == texts[i] for i in range(100) if i not in hit)
    for i, r in hit.items():
        raw = texts[i].encode()
        assert kept[i].encode() == raw[: r["start"]] + raw[r["stop"] :]


def test_near_paragraphs_join_through_a_third(spark):
    """a and c are not similar, but both are to b."""
    rng = np.random.default_rng(4)
    base = prose(rng, 100)
    b = list(base)
    b[20] = "changed"
    c = list(b)
    c[70] = "altered"
    c[72] = "again"
    texts = ["\n".join([" ".join(prose(rng, 30)), " ".join(x)]) for x in (base, b, c)]
    found = repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["kept_doc_id"], r["n_words"]) for r in found) == [(1, 0, 100), (2, 0, 100)]


def test_odd_rows(spark):
    df = odd.documents(spark)
    kept = cut_documents(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    # Equal rows are one document and keep the first of four equal sentences; documents with nothing
    # left are gone, those without words to begin with stay.
    six = [t for _, i, t in found if i == 6 and t.startswith("Once")]
    assert len(six) == 2 and six[0] == six[1] and len(odd.words(odd.PROSE)) <= len(odd.words(six[0])) <= 1.5 * len(odd.words(odd.PROSE))
    assert {1, 2, 3, 4, 5, 8, 9, 11, 12, -20} <= {i for _, i, _ in found} and (False, 7) not in {f[:2] for f in found}
    assert cut_documents(odd.nothing(spark)).count() == 0 and repeated_spans(odd.nothing(spark)).count() == 0


def test_cuts_follow_the_words_alone():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 2**63, 200).astype(np.uint64)
    line = np.zeros(200, int)
    whole = cut_points(words, line)
    part = cut_points(words[50:150], line[:100])
    assert (whole[60:140] == part[10:90]).all()
    assert word_places([b"", b" a bc\nd ", b"e"])[1].tolist() == [1, 3, 6, 0]


def test_passages_in_short_lines(spark):
    """Passages of 51 words in lines of 1 to 10, with any white space between the lines, between prose laid out alike."""
    rng = np.random.default_rng(8)

    def laid_out(words, width, gap):
        return gap.join(" ".join(words[i : i + width]) for i in range(0, len(words), width))

    texts = []
    for width in range(1, 11):
        for gap in ("\n", "\r\n\r\n", "\n    \n", "\n\n\n"):
            passage = prose(rng, 51)
            texts += [laid_out(prose(rng, 37) + passage + prose(rng, 41), w, gap) for w in (width, width, 11 - width)]
    lone = prose(rng, 51)  # a line of 3 words between longer ones
    texts += ["\n".join(" ".join(x) for x in (prose(rng, 30) + lone[:24], lone[24:27], lone[27:] + prose(rng, 30))) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    gone = {}
    for r in repeated_spans(df).collect():
        assert r["kept_doc_id"] == r["doc_id"] - r["doc_id"] % 3 and 15 <= r["n_words"] <= 51
        gone[r["doc_id"]] = gone.get(r["doc_id"], 0) + r["n_words"]
    assert set(gone) == {i for i in range(len(texts)) if i % 3}
    assert min(gone.values()) >= 20 and np.mean(list(gone.values())) >= 35


def test_near_copies_of_short_lines(spark):
    """A line of 17 words, and five lines of 12 joined, each with one word changed, between other lines."""
    rng = np.random.default_rng(9)
    one, five = prose(rng, 17), prose(rng, 60)
    texts = []
    for changed in (False, True):
        a, b = list(one), list(five)
        if changed:
            a[-1], b[23] = "changed", "altered"
        lines = [prose(rng, 30), a, prose(rng, 30), b[:12], b[12:24], b[24:36], b[36:48], b[48:], prose(rng, 30)]
        texts.append("\n".join(" ".join(x) for x in lines))
    found = repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in found) == [(1, 17), (1, 60)]


def test_near_copies_inside_longer_lines(spark):
    """Passages of 60 words with one word changed in the middle, and of 100 with two, inside lines of other words."""
    rng = np.random.default_rng(10)
    texts = []
    for k in range(60):
        passage = prose(rng, 60 if k % 2 else 100)
        copy = list(passage)
        for at in (30,) if k % 2 else (33, 67):
            copy[at] = "changed"
        texts += [" ".join(prose(rng, int(rng.integers(30, 90))) + x + prose(rng, int(rng.integers(30, 90)))) for x in (passage, copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    gone = {}
    for r in repeated_spans(df).collect():
        assert r["kept_doc_id"] == r["doc_id"] - 1
        gone[r["doc_id"]] = gone.get(r["doc_id"], 0) + r["n_words"]
    assert set(gone) == set(range(1, 120, 2))
    assert all(gone[i] >= (50 if i // 2 % 2 else 85) for i in gone)


def test_aligned_stretches():
    a = list(range(100, 160))
    b = a[:30] + [7] + a[31:]
    inside = [1, 2, 3] + b + [4, 5]
    assert similar_stretches(inside, [9, *a, 8], [(20, 18)], 0.8) == [(3, 63, 1, 61)]
    assert similar_stretches(inside, [9, *a, 8], [(20, 18)], 0.9) == [(3, 33, 1, 31), (34, 63, 32, 61)]
    assert similar_stretches(a[:20] + a[22:], a, [(4, 4)], 0.8) == [(0, 58, 0, 60)]


def test_what_goes_is_present_in_what_stays(spark):
    """Every removed span of the given documents, shingle by shingle, and its columns."""
    docs = dict(odd.table(SMALL, "documents", "doc_id, text"))
    spans = op10_paragraphs(spark, SMALL).collect()
    stays = set()
    for r in cut_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).collect():
        stays |= shingles(odd.words(r["text"]))
    kept_whole = {d: shingles(odd.words(t)) for d, t in docs.items()}
    for r in spans:
        gone = odd.words(docs[r["doc_id"]].encode()[r["start"] : r["stop"]].decode())
        assert r["n_words"] == len(gone) >= 15
        found = shingles(gone)
        assert len(found & stays) >= 0.75 * len(found), r
        assert r["kept_doc_id"] == r["doc_id"] or found & kept_whole[r["kept_doc_id"]], r


def test_a_passage_stays_where_its_first_copy_is_not_removed(spark):
    """b's line is a near copy of a's and goes; the passage in which they differ is also in c, and stays there."""
    rng = np.random.default_rng(11)
    base, passage = prose(rng, 300), prose(rng, 25)
    near = base[:140] + passage + base[165:]
    texts = [" ".join(base), " ".join(near), " ".join(prose(rng, 40) + passage + prose(rng, 40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [(r["doc_id"], r["kept_doc_id"], r["n_words"]) for r in repeated_spans(df).collect()] == [(1, 0, 300)]
    assert sorted((r["doc_id"], r["text"]) for r in cut_documents(df).collect()) == [(0, texts[0]), (2, texts[2])]


def test_copies_of_whole_texts_and_of_their_passages(spark):
    """The copy of a text goes as a whole, also where the original loses a passage to an earlier document."""
    rng = np.random.default_rng(12)
    passage = prose(rng, 50)
    one, two = prose(rng, 60) + passage + prose(rng, 60), prose(rng, 45) + passage + prose(rng, 45)
    texts = [" ".join(one), " ".join(two), " ".join(two), "too short to go", "too short to go"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted((r["doc_id"], r["kept_doc_id"], r["n_words"]) for r in repeated_spans(df).collect())
    assert [f[:2] for f in found] == [(1, 0), (2, 1)] and 40 <= found[0][2] <= 50 and found[1][2] == 140
    assert sorted(r["doc_id"] for r in cut_documents(df).collect()) == [0, 1, 3, 4]


def test_texts_without_an_id_are_told_apart_by_their_whole_hashes(spark):
    """Two texts whose 64-bit hashes agree in their last 32 bits, under no id, are cut each at its own places."""
    rng = np.random.default_rng(13)
    passage = " ".join(prose(rng, 60))
    seen, pair = {}, None
    for i in range(400_000):
        text = f"{' '.join([f'ö{i}x{k}' for k in range(25 + i % 4)])} {passage} {' '.join([f'{i}é{k}' for k in range(25)])}"
        low = xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF
        if low in seen and len(seen[low].split(passage)[0]) != len(text.split(passage)[0]):
            pair = [seen[low], text]
            break
        seen[low] = text
    assert pair
    rows = [(0, f"before {passage} after"), (None, pair[0]), (None, pair[1])]
    kept = [r["text"] for r in cut_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(kept) == 3 and rows[0][1] in kept
    for text in pair:
        head, tail = text.split(passage)
        left = [k for k in kept if k.startswith(head) and k.endswith(tail)]
        assert len(left) == 1 and set(odd.words(left[0])) < set(odd.words(text)) and len(odd.words(left[0])) < 80


def test_tables_go_when_what_follows_from_them_is_written(spark, tmp_path, monkeypatch):
    """Before the spans are read, only what they are made from is left, also in a folder with odd letters."""
    rng = np.random.default_rng(14)
    passage, line = " ".join(prose(rng, 60)), prose(rng, 40)
    near = " ".join([*line[:20], "changed", *line[21:]])
    texts = [f"{' '.join(prose(rng, 30))} {passage} {' '.join(prose(rng, 30))}\n{x}" for x in (" ".join(line), near, "")]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[0])], "doc_id bigint, text string")
    monkeypatch.setattr(workspace, "shared_folder", lambda _: str(tmp_path / "a folder %20"))
    spans = repeated_spans(df)
    left = {re.sub(r"-[0-9a-f]{32}$", "", p.name) for p in (tmp_path / "a folder %20").glob("gradewell/*/*")}
    assert left - {"checkpoints", "paragraphs"} == {"uncovered", "pieces", "windows"}
    found = [sorted((r["doc_id"], r["kept_doc_id"]) for r in spans.collect()) for _ in range(2)]
    assert found[0] == found[1] and set(found[0]) == {(1, 0), (2, 0), (3, 0)}
    other = str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    with pytest.raises(ValueError, match="not a staged table"):
        workspace.discard(spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 3


def test_words_that_are_alike_are_hashed_once(monkeypatch):
    texts = [b"", b" One two\tONE\n\xc3\x84 \xc3\xa4 two ", b"\n\n", b"two\x0bx" + b" one" * 500, b"y" * 100]
    calls, plain = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda value: calls.append(value) or plain(value))
    hashes, *places = paragraphs.hashed_words(texts)
    words = [w for raw in texts for w in raw.translate(bytes.maketrans(b"OTNEW", b"otnew")).split()]
    assert hashes.tolist() == [plain(w) for w in words] and sorted(calls) == sorted(set(words))
    for one, two in zip(places, word_places(texts)):
        assert one.tolist() == two.tolist()
    assert [len(x) for x in paragraphs.hashed_words([b"", b" "])] == [0] * 5


def test_units_joined_like_one_after_another():
    """Random units of several texts, some without a kept id, against joining them one at a time."""
    rng = np.random.default_rng(11)
    names = ("start", "stop", "at", "words", "component", "kept")
    for _ in range(200):
        rows = np.sort(rng.integers(0, 4, 30))
        units = []
        for k in range(len(rows)):
            at, words = int(rng.integers(0, 60)), int(rng.integers(1, 12))
            kept = None if rng.random() < 0.3 else int(rng.integers(0, 5))
            units.append(dict(zip(names, (at * 10, (at + words) * 10, at, words, k, kept))))
        expected = []
        for row, unit in sorted(zip(rows.tolist(), units), key=lambda x: (x[0], x[1]["at"], -x[1]["words"], x[1]["component"])):
            last = expected[-1] if expected and expected[-1]["row"] == row else None
            end = unit["at"] + unit["words"]
            if last and end <= last["at"] + last["words"]:
                continue
            if last and unit["at"] <= last["at"] + last["words"]:
                last["words"], last["stop"] = end - last["at"], unit["stop"]
                if unit["kept"] is not None and (last["kept"] is None or unit["kept"] < last["kept"]):
                    last["kept"], last["component"] = unit["kept"], unit["component"]
            else:
                expected.append({"row": row} | unit)
        kind = pa.struct([(name, pa.int64()) for name in names])
        row, runs = paragraphs.merged(rows, pa.array(units, kind))
        found = list(zip(row.tolist(), *(runs[k].to_pylist() for k in ("start", "stop", "n_words", "component_id", "kept_doc_id"))))
        assert found == [tuple(e[k] for k in ("row", "start", "stop", "words", "component", "kept")) for e in expected]


def test_chains_of_units():
    #                 first, goes on, inside it, gap over 30, kept text goes back, other text
    follows = [False, True, True, True, True, False]
    at, kept_at, words = [5, 15, 16, 60, 70, 0], [105, 116, 117, 150, 140, 9], [10, 8, 3, 6, 9, 7]
    assert paragraphs.chains(follows, at, kept_at, words) == ([0, 1, 3, 4, 5], [0, 2, 3, 4])
