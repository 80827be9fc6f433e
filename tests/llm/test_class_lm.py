import collections
import math
import zlib

import numpy as np
import odd
import pytest

from gradewell.llm.class_lm import ADD, ENDINGS, Units, class_lm_scores, exchange_classes, fit_classes, fold, score_texts, word_counts
from gradewell.llm.queries import op3_class_lm

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return [w.encode() for w in odd.words(text)] + [b""]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def expected_base(rows):
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total = sum(counts.values())
    out = []
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10((counts[x] + ADD) / (total + ADD * (len(counts) + 1))) for x in w)
        out.append((i is None, i or 0, held(i), len(w), sum(counts[x] > 0 for x in w), total, round(score, 6)))
    return sorted(out)


def base(df):
    return sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in df.collect()
    )


def test_whole_table(spark):
    found = op3_class_lm(spark, SMALL).cache()
    assert base(found) == expected_base(odd.table(SMALL, "documents", "doc_id, text"))
    rows = found.where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in rows)


@pytest.mark.parametrize("lookup", [100_000, 8])
def test_odd_rows_and_rare_words(spark, lookup):
    """With a look-up of 8 words nearly all counts come by the join."""
    found = class_lm_scores(odd.documents(spark), cluster_words=20, classes=4, lookup_words=lookup)
    assert base(found) == expected_base([r[:2] for r in odd.rows()])
    assert all(r["score"] < 0 for r in found.collect())
    assert class_lm_scores(odd.nothing(spark), cluster_words=20, classes=4).count() == 0


def test_scores_follow_the_definition_and_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["aa", "ba", "cb", "db", "ec", "fc"], 12))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = df.where(~fold("doc_id")).select("text")
    counts = word_counts(train).cache()
    model = fit_classes(train, counts, cluster_words=4, classes=4)
    n = {r["word"]: r["n"] for r in counts.collect()}
    n = {bytes(k): v for k, v in n.items()}
    cls = {w: int(model.of_unit[model.units.of(w)]) for w in n}
    size, kinds = collections.Counter(), collections.Counter(cls.values())
    for w, c in n.items():
        size[cls[w]] += c
    pairs = collections.Counter()
    for i, t in rows:
        if not held(i):
            line = [b"", *tokens(t)]
            pairs.update((cls[a], cls[b]) for a, b in zip(line, line[1:]))
    classes = len(model.class_total)
    share = np.array([size[c] + 0.5 for c in range(classes)])
    share /= share.sum()

    def p(a, b, word):
        out = sum(v for (x, _), v in pairs.items() if x == a)
        return (pairs[a, b] + 5.0 * share[b]) / (out + 5.0) * (n.get(word, 0) + ADD) / (size[b] + ADD * (kinds[b] + 1))

    for a in range(classes):  # all known words, and one unseen word per class
        total = sum(p(a, cls[w], w) for w in n) + sum(p(a, b, b"unseen") for b in range(classes))
        assert abs(total - 1) < 1e-9
    found = {r["doc_id"]: r["score"] for r in score_texts(df, model, counts).collect()}
    for i, t in rows:
        line = [b"", *tokens(t)]
        assert abs(found[i] - sum(math.log10(p(cls[a], cls[b], b)) for a, b in zip(line, line[1:]))) < 1e-9


def test_exchange_finds_classes_that_alternate():
    rng = np.random.default_rng(0)
    kinds = np.r_[0, np.repeat([1, 2, 3], 8)]
    rate = np.array([[0, 9, 1, 1], [3, 1, 20, 1], [3, 1, 1, 20], [9, 20, 1, 1]])
    bigrams = rng.poisson(rate[np.ix_(kinds, kinds)]).astype(float)
    of = exchange_classes(bigrams, 4)
    assert of[0] == 0 and all(len(set(of[kinds == k])) == 1 for k in (1, 2, 3)) and len(set(of)) == 4


def test_units():
    units = Units({b"the": 1, b"of": 2})
    assert units.of(b"") == 0 and units.of(b"of") == 2 and 3 <= units.of(b"xyz") == units.of(b"ayz") < units.size == 3 + ENDINGS
