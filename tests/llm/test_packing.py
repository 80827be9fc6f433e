import zlib

import numpy as np
import odd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradewell.llm.packing import pack, plan_packing, sequences
from gradewell.llm.queries import PACKING_TOKENIZER, op2_best_fit_packing, tokenizer_path

SMALL = "/root/testdata/sf0.001"


def pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(tokenizer_path(PACKING_TOKENIZER))
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc is None, doc or 0, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check(found, rows, capacity):
    got = found.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(rows, capacity)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values(), default=0) <= capacity
    return len(filled), sum(filled.values())


def test_whole_table(spark):
    used, tokens = check(op2_best_fit_packing(spark, SMALL), odd.table(SMALL, "documents", "doc_id, text"), 2048)
    assert used <= -(-tokens // 2048) * 1.02 + 1


def test_odd_rows_and_their_sequences(spark):
    path = tokenizer_path(PACKING_TOKENIZER)
    rows = [r[:2] for r in odd.rows()]
    found = pack(odd.documents(spark), path, 64, with_ids=True)
    check(found, rows, 64)
    for r in sequences(found).collect():
        assert len(r["input_ids"]) == sum(r["lengths"]) <= 64
    assert pack(odd.nothing(spark), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40)))
def test_plan(counts):
    slots, used = plan_packing(counts, 30)
    places, ranks = {}, {}
    for s in slots:
        ranks.setdefault(s.length, []).extend(range(s.rank, s.rank + s.bins * s.copies))
        for b in range(s.bins):
            for c in range(s.copies):
                places.setdefault(s.sequence + b, []).append((s.offset + c * s.length, s.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert len(places) == used
    for parts in places.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 30
        assert sum(length > 10 for _, length in parts) <= 2
    total = sum(k * n for k, n in counts.items())
    assert used <= max(-(-total // 30) * 1.7, sum(n for k, n in counts.items() if k > 10), 1) + 1


def test_words_alone_give_the_tokenizers_ids():
    """The fast way, the look-up of words and the tokenizer itself agree on any text."""
    import random
    from pathlib import Path

    from gradewell.llm.packing import _encoder

    source = Path(tokenizer_path(PACKING_TOKENIZER)).read_text(encoding="utf-8")
    tokenizer, encode, slow = Tokenizer.from_str(source), _encoder(source), _encoder(source, False)
    letters = [chr(c) for c in range(0x20, 0x250)]
    letters += [*"İΣςσ東京한국éèñ'sStT’ \t\n\x1c\x85ﬁ①½²ªº😀_%&$#*|<>-", " ", "é", "'s", "'LL", "'re", "<|endoftext|>", " ", " "]
    rng = random.Random(0)
    for _ in range(5_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        wanted = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(text) == wanted == slow(text), text
