import hashlib
import random
import re
import zlib

import numpy as np
import odd

from gradewell.llm.periodic_runs import collapse, find_runs, periodic_runs
from gradewell.llm.queries import op11_periodic_runs

SMALL = "/root/testdata/sf0.001"


def runs_of(words, least=2):
    """All maximal runs, by comparing the words with themselves at every distance."""
    n, found, numbers = len(words), {}, {}
    a = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for q in range(1, n // 2 + 1):
        equal = np.r_[False, a[: n - q] == a[q:], False]
        for i, j in np.flatnonzero(np.diff(equal)).reshape(-1, 2).tolist():
            if j - i >= q:
                found.setdefault((i, j + q), q)
    return sorted((i, j - i, q) for (i, j), q in found.items() if j - i >= least)


def kept(words, runs):
    gone = set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words, 12)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept(words, runs)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query_against_all_distances(spark):
    rows = odd.table(SMALL, "documents", "doc_id, text")
    assert result(op11_periodic_runs(spark, SMALL)) == sorted((expected(*r) for r in rows), key=str)


def test_odd_rows(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(op11_periodic_runs(spark, str(tmp_path))) == sorted((expected(*r[:2]) for r in odd.rows()), key=str)
    found = {r["doc_id"]: r for r in periodic_runs(odd.documents(spark).where("doc_id in (2, 11)")).collect()}
    assert found[2]["runs"] == [] and found[2]["n_words"] == 0 and found[2]["collapsed"] == ""
    assert [tuple(x) for x in found[11]["runs"]] == [(0, 3000, 1)] and found[11]["collapsed"] == "de"
    assert periodic_runs(odd.nothing(spark)).count() == 0


def texts():
    random.seed(5)
    for _ in range(300):
        k = random.choice([1, 2, 3, 5])
        yield [random.randrange(k) for _ in range(random.randint(0, 300))]
    for p in range(1, 14):  # regions of one period that meet: as many periods as they are long
        for k in (3, 8, 20):
            unit = list(range(p))
            for cut in range(p):
                yield unit * k + unit[:cut] + unit * k
                yield [99] + unit * k + unit[:cut] + unit * (k + 1) + unit[:1] + unit * k
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    yield b
    for _ in range(200):
        w = [random.randrange(2) for _ in range(random.randint(1, 6))]
        while len(w) < 400 and random.random() < 0.9:
            w = w * random.randint(1, 4) + w[: random.randint(0, len(w))] + [random.randrange(3) for _ in range(random.randint(0, 2))]
        yield w[:700]
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    yield thue
    yield thue[:700] * 3 + thue[:123]


def test_nested_and_adjacent_periods():
    cases = list(texts())
    found = find_runs([np.array(c, np.int64) for c in cases])
    for words, runs in zip(cases, found):
        assert [tuple(r) for r in runs.tolist()] == runs_of(words)


def test_collapse_keeps_the_first_period():
    words = [b"x", *[b"a", b"b", b"c"] * 4, b"a", b"y"]
    runs = find_runs([np.array([3, *[0, 1, 2] * 4, 0, 4], np.int64)], 12)[0]
    assert runs.tolist() == [[1, 13, 3]]
    assert collapse(words, runs) == b"x a b c y"
