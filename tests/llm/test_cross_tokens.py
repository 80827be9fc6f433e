import hashlib
import random
from collections import Counter

import odd
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gradewell.llm.cross_tokens import Aligner, aligned, with_counts
from gradewell.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, op12_cross_tokens, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATHS = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)


def letters():
    """Letter of a byte-level vocabulary -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(rows):
    """doc_id -> columns, from whole texts and one dictionary of pairs."""
    a_model, b_model = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    to_byte = letters()
    documents, counts = [], Counter()
    for doc_id, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            bytes_a = [bytes(to_byte[x] for x in a_model.id_to_token(i)) for i in a]
            pieces = [b_model.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            raw = (" " + text).encode()
            if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
                a = b = []
            i = j = x = y = i0 = j0 = 0
            while i < len(a) or j < len(b):
                if j == len(b) or (i < len(a) and x <= y):
                    x += len(bytes_a[i])
                    i += 1
                else:
                    y += len(bytes_b[j])
                    j += 1
                if x == y:
                    groups.append((a[i0:i], b[j0:j]))
                    links.append((a[i - 1], b[j - 1]))
                    i0, j0 = i, j
        counts.update(links)
        documents.append((doc_id, a, b, groups, links))
    highest = {}
    for (x, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    found = []
    for doc_id, a, b, groups, links in documents:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        found.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(found, key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query_against_one_dictionary(spark):
    assert result(op12_cross_tokens(spark, SMALL)) == plain(odd.table(SMALL, "documents", "doc_id, text"))


def test_odd_rows(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(op12_cross_tokens(spark, str(tmp_path))) == plain([r[:2] for r in odd.rows()])
    assert with_counts(aligned(odd.nothing(spark), *PATHS)).count() == 0


def test_many_runs_give_the_same_counts(spark):
    """Runs of a few documents, and radix partitions with one or several tokens of B in them."""
    rows = odd.table(SMALL, "documents", "doc_id, text")[:60]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = [r[:7] for r in plain(rows)]
    for run_links, parts in ((50, 1), (500, 8), (10**9, 1024)):
        found = with_counts(aligned(df, *PATHS, run_links=run_links, parts=parts))
        assert [r[:7] for r in result(found.withColumnRenamed("groups", "groups_sha256"))] == expected


def test_segments_are_independent():
    aligner = Aligner(*PATHS)
    random.seed(3)
    alphabet = [" ", " ", " ", "a", "the", "'s", "'", "\n", "\t", " ", "é", "東", "1", "23", ".", ",", "▁", "\x1c", "　", "é", "\U0001f600"]
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(1, 14)))
        parts = aligner.segments(text)
        assert " ".join(parts) == text
        assert sum(aligner.encode_a(parts), []) == aligner.a.encode(" " + text, add_special_tokens=False).ids
        assert sum((aligner.b.encode(p) for p in parts), []) == aligner.b.encode(text)


def test_groups_read_as_stated(spark):
    found = aligned(spark.createDataFrame([(1, "Hello there"), (2, "a▁b")], "doc_id bigint, text string"), *PATHS)
    rows = {r["doc_id"]: r for r in found.where("part is null").collect()}
    ids = [[int(x) for x in side.split(",")] for group in rows[1]["groups"].split(";") for side in group.split("|")]
    a_model, b_model = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    assert sum(ids[0::2], []) == a_model.encode(" Hello there", add_special_tokens=False).ids
    assert sum(ids[1::2], []) == b_model.encode("Hello there")
    assert rows[2]["n_a"] == rows[2]["n_links"] == 0 and rows[2]["groups"] == ""
