import hashlib
import random

import odd
from pyspark.sql import functions as F

from gradewell.llm import context_hash
from gradewell.llm.context_hash import compare_with_next, fingerprints, fingerprints_of, likeness, likeness_of
from gradewell.llm.queries import op13_context_hash

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_print(raw):
    """The fingerprint, byte by byte."""
    if not raw:
        return "1::::"
    hashes = []
    for i in range(len(raw)):
        x = 0
        for k in range(min(i, 6) + 1):
            x += (raw[i - k] + 1) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)
        x &= MASK
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
        hashes.append(x ^ (x >> 31))

    def chunks(level):
        found, total, n = {}, 0, 0
        for i, x in enumerate(hashes):
            total = (total + x) & MASK
            if x % (1 << level) == 0 or i == len(hashes) - 1:
                found[total] = None
                total, n = 0, n + 1
        return list(found), n

    lowest = max(1, (len(raw) // 64).bit_length() - 8)
    level = lowest
    while chunks(level)[1] > 64:
        level += 1
    while level > lowest and len(chunks(level - 1)[0]) <= 64:
        level -= 1
    parts = ["".join(LETTERS[x >> 58] + LETTERS[x >> 52 & 63] for x in chunks(level + k)[0]) for k in range(4)]
    return ":".join([str(level), *parts])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (la, *sa), (lb, *sb) = a.split(":"), b.split(":")
    top = max(int(la), int(lb))
    if top - min(int(la), int(lb)) > 3:
        return 0.0
    x, y = sa[top - int(la)], sb[top - int(lb)]
    x, y = [x[i : i + 2] for i in range(0, len(x), 2)], [y[i : i + 2] for i in range(0, len(y), 2)]
    row = list(range(len(y) + 1))
    for i, p in enumerate(x):
        new = [i + 1]
        for j, q in enumerate(y):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (0 if p == q else 2)))
        row = new
    return 1 - row[-1] / (len(x) + len(y)) if x or y else 1.0


def plain(rows):
    """The columns of the query, for rows in the order of the operator."""
    found = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, other = plain_print(text.encode()), plain_print(edited.encode())
        found.append((
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other,
            round(plain_likeness(own, other), 12), round(plain_likeness(own, plain_print(after.encode())), 12),
        ))
    return sorted(found, key=str)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]


def result(df):
    return sorted((
        (*[r[c] for c in NAMES], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in df.collect()
    ), key=str)


def sha(df):
    return df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))


def ordered(spark, rows):
    """By descending id, then the two hashes that order the texts of one id."""
    df = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id bigint, text string")
    df = df.withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit("second"), "text"))
    return [(r[0], r[1]) for r in df.orderBy(F.desc_nulls_last("doc_id"), "h", "g").collect()]


def test_query_byte_by_byte(spark):
    rows = odd.table(SMALL, "documents", "doc_id, text")
    rows = sorted(rows, key=lambda r: -r[0])
    assert result(op13_context_hash(spark, SMALL)) == plain(rows)


def test_ranges_and_odd_rows(spark, monkeypatch):
    rows = [r[:2] for r in odd.rows() if len(r[1] or "") < 100_000]
    df = odd.documents(spark).where("length(coalesce(text, '')) < 100000")
    for size in (1, 3, 2_000):
        monkeypatch.setattr(context_hash, "RANGE_ROWS", size)
        assert result(sha(compare_with_next(df))) == plain(ordered(spark, rows))
    assert compare_with_next(odd.nothing(spark)).count() == 0
    one = spark.createDataFrame([(5, "alone in the table")], "doc_id bigint, text string")
    assert result(sha(compare_with_next(one))) == plain([(5, "alone in the table")])


def test_a_third_of_all_rows_is_one_document(spark, monkeypatch):
    monkeypatch.setattr(context_hash, "COPIES", 5)
    monkeypatch.setattr(context_hash, "RANGE_ROWS", 4)
    rows = [(7, "the same text again and again")] * 20 + [(i, f"text number {i} " * 9) for i in range(40)] + [(None, "x")] * 12
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(sha(compare_with_next(df))) == plain(ordered(spark, rows))


def test_prints_do_not_depend_on_neighbours_or_blocks(monkeypatch):
    random.seed(2)
    texts = [bytes(random.randrange(256) for _ in range(n)) for n in (0, 1, 6, 7, 500, 3_000)]
    texts += [b"\0" * 400, b"ab" * 3_000, b"", b"one line\n" * 700 + texts[-1]]
    expected = [plain_print(t) for t in texts]
    assert fingerprints_of(texts) == expected
    assert [fingerprints_of([t])[0] for t in texts] == expected
    for block in (50, 777):
        monkeypatch.setattr(context_hash, "BLOCK", block)
        assert fingerprints_of(texts) == expected


def test_likeness_by_edit_distance(spark):
    random.seed(4)
    prints = []
    for _ in range(60):
        parts = ["".join(random.choice("AB") + "x" for _ in range(random.randint(0, 66))) for _ in range(4)]
        prints.append(":".join([str(random.randint(1, 7)), *parts]))
    for a in prints:
        for b in prints:
            assert abs(likeness(a, b) - plain_likeness(a, b)) < 1e-12
    df = spark.createDataFrame([(prints[0], prints[1]), (prints[0], prints[0]), (None, prints[0])], "a string, b string")
    found = [r[0] for r in df.select(likeness_of(F.col("a"), F.col("b"))).collect()]
    assert found[1:] == [1.0, None] and abs(found[0] - plain_likeness(*prints[:2])) < 1e-12


def test_edits_keep_likeness(spark):
    rows = fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    texts = dict(odd.table(SMALL, "documents", "doc_id, text"))
    long = [r for r in rows if r["n_chars"] > 1_000][:40]
    for r in long:
        text = texts[r["doc_id"]]
        changed = text[: len(text) // 2] + " some other words " + text[len(text) // 2 :]
        assert likeness(r["fingerprint"], fingerprints_of([changed.encode()])[0]) > 0.6
