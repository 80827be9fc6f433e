import collections
import hashlib

import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm.queries import op1_suffix_dedup
from gradewell.llm.repeated_bytes import repeated_bytes
from gradewell.llm.suffix_groups import repeated_prefixes, suffix_array

SMALL = "/root/testdata/sf0.001"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(r, gone[1:-1]) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def expected(ids, texts, length=400):
    return sorted((i is None, i or 0, *b) for i, b in zip(ids, brute(texts, length)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=3, max_size=60))
def test_repeated_prefixes(symbols):
    starts = np.arange(len(symbols) - 2)
    seen = collections.Counter(tuple(symbols[i : i + 3]) for i in starts)
    assert repeated_prefixes(np.array(symbols), starts, 3).tolist() == [seen[tuple(symbols[i : i + 3])] > 1 for i in starts]


def test_whole_table(spark):
    ids, texts = zip(*odd.table(SMALL, "documents", "doc_id, text"))
    assert result(op1_suffix_dedup(spark, SMALL)) == expected(ids, texts)


def test_odd_rows(spark):
    ids, texts = zip(*[r[:2] for r in odd.rows()])
    assert result(repeated_bytes(odd.documents(spark))) == expected(ids, texts)
    assert repeated_bytes(odd.nothing(spark)).count() == 0


@pytest.mark.parametrize("group", [1_024, 2])
def test_small_lengths_and_finer_blocks(spark, group):
    """group=2 sends every middle with three strings or more down to single windows."""
    rng = np.random.default_rng(5)
    common = "".join(rng.choice(list("abcd"), 60))
    texts = [
        "".join(rng.choice(list("ab"), rng.integers(0, 6))) + common[a:b] + "".join(rng.choice(list("abc"), rng.integers(0, 90)))
        for a, b in rng.integers(0, 60, (120, 2))
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = repeated_bytes(df, length=20, gram=8, widths=(8, 4, 1), group=group)
    assert result(found) == expected(range(len(texts)), texts, 20)
    for r in found.collect():
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_long_text_in_parts(spark, monkeypatch):
    from gradewell.llm import repeated_bytes as module

    monkeypatch.setattr(module, "SEGMENT", 300)
    texts = [odd.PROSE * 9, "x" + odd.PROSE * 5 + "y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert result(repeated_bytes(df)) == expected(range(3), texts)
