import collections
import math
import string

import numpy as np
import odd
from pyspark.sql import functions as F

from gradewell.llm.quality import RIDGE, OrdinalModel, fit_ordinal, fit_quality, grade_documents, keep_good
from gradewell.llm.queries import grade, op5_quality_classifier

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_held_out_documents_are_graded_right(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    model = fit_quality(docs, train, grade(), 3)
    assert model.thresholds == sorted(model.thresholds) and model.weights
    rows = grade_documents(docs, model).join(rest.withColumn("grade", grade()), "doc_id").collect()
    toxic = [r for r in rows if r["grade"] == 0]
    clean = [r for r in rows if r["grade"] > 0]
    assert np.mean([not r["keep"] for r in toxic]) >= 0.85 and np.mean([r["keep"] for r in clean]) >= 0.97
    mean = {g: np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]


def test_whole_table(spark):
    rows = op5_quality_classifier(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for (d,) in odd.table(SMALL, "documents", "doc_id"))
    assert all(0 <= r["p_top"] <= r["p_above_0"] <= 1 and abs(r["expected_grade"] - r["p_above_0"] - r["p_top"]) < 1e-9 for r in rows)


def test_fit_minimises_the_likelihood():
    """No small step from the fitted thresholds and weights lowers the penalised likelihood much."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 3))
    grades = np.clip((x @ [2, -1, 1] + rng.normal(0, 1, 400)).round().astype(int) + 1, 0, 3)
    rows = [np.flatnonzero(r) + 10 for r in x]
    model = fit_ordinal(rows, grades, 4)
    names = sorted(model.weights)
    index = {f: i for i, f in enumerate(names)}

    def loss(w, t):
        z = np.array([sum(w[index[f]] for f in r) for r in rows])
        tails = np.c_[np.ones(400), OrdinalModel({}, list(t)).tails(z), np.zeros(400)]
        return -np.log(tails[np.arange(400), grades] - tails[np.arange(400), grades + 1]).sum() + RIDGE / 2 * np.square(w).sum()

    w, t = np.array([model.weights[f] for f in names]), np.array(model.thresholds)
    best = loss(w, t)
    for k in range(len(w) + len(t)):
        for step in (-0.05, 0.05):
            moved = np.r_[w, t]
            moved[k] += step
            assert loss(moved[: len(w)], moved[len(w) :]) > best - 0.01


def test_odd_rows(spark):
    df = odd.documents(spark)
    labels = spark.createDataFrame(
        [(6, 1, 0, "x"), (6, 0, 1, "x"), (9, 1, 0, "x"), (11, 0, 0, "x"), (None, 1, 1, "x"), (5, None, 0, "x"), (4, 1, None, "x"), (77, 1, 1, "x")],
        "doc_id bigint, quality int, toxic int, text string",
    )
    model = fit_quality(df, labels, grade(), 3)
    found = grade_documents(df, model)
    assert found.count() == len(odd.rows()) and found.where("expected_grade is null").count() == 0
    assert keep_good(df, model).columns == df.columns
    assert grade_documents(odd.nothing(spark), model).count() == 0
    nobody = fit_quality(df, labels.limit(0), grade(), 3)
    assert grade_documents(df, nobody).where("keep and expected_grade is null").count() == len(odd.rows())
    assert keep_good(df, nobody).count() == len(odd.rows())
    same = fit_quality(df, labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1)), grade(), 3)
    assert grade_documents(df, same).where("not keep").count() == 0


def test_an_id_with_many_rows_is_one_row_of_the_fit(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").select(*c) for t, c in (("documents", ["doc_id", "text"]), ("labels", ["doc_id", "toxic", "quality"])))
    one = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    many = docs.unionByName(one.crossJoin(spark.range(300)).select("doc_id", "text"))
    once, often = (fit_quality(d, labels, grade(), 3) for d in (docs, many))
    assert once.thresholds and once == often


def plain_features(text):
    """Words without signs around them, their beginnings, the signs at their ends; and those that are dense."""
    words, times = odd.words(text), collections.Counter()
    signs = string.punctuation
    for w in words:
        bare, kinds = w.strip(signs).encode(), set()
        if bare:
            kinds = {("word", bare)} | {("begins", bare[:n]) for n in (4, 5, 6, 7, 8) if n < len(bare)}
        if w.rstrip(signs) != w:
            kinds.add(("ends", w[len(w.rstrip(signs)) :].encode()))
        times.update(kinds)
    dense = {(*f, level) for level, share in enumerate((1 / 300, 1 / 80, 1 / 20), 1) for f, n in times.items() if n >= max(2, share * len(words))}
    return set(times) | dense


def g_statistic(a, has, below, total):
    cells = [(a, has * below / total), (has - a, has * (total - below) / total), (below - a, (total - has) * below / total),
             (total - below - has + a, (total - has) * (total - below) / total)]
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)


def test_registered_query_against_plain_python(spark):
    """Features, their choice and the scores, from the words themselves; the fit has a test of its own."""
    texts = dict(odd.table(SMALL, "documents", "doc_id, text"))
    rated = {}
    for d, quality_, toxic in odd.table(SMALL, "labels", "doc_id, quality, toxic"):
        g = 0 if toxic == 1 else quality_ + 1
        rated[d] = min(g, rated.get(d, g))
    ids = sorted(d for d in rated if d in texts)
    features, grades = {d: plain_features(texts[d]) for d in texts}, np.array([rated[d] for d in ids])
    has = collections.Counter(f for d in ids for f in features[d])
    chosen = set()
    for k in (0, 1):
        low = collections.Counter(f for d in ids if rated[d] <= k for f in features[d])
        below = int((grades <= k).sum())
        for f, n in has.items():
            if n >= 3 and low[f] * len(ids) > n * below and g_statistic(low[f], n, below, len(ids)) >= 15:
                chosen.add(f)
    assert 0 < len(chosen) < 2_048
    number = {f: i for i, f in enumerate(sorted(chosen, key=str))}
    model = fit_ordinal([np.array(sorted(number[f] for f in features[d] & chosen), np.int64) for d in ids], grades, 3)
    for r in op5_quality_classifier(spark, SMALL).collect():
        z = sum(model.weights[number[f]] for f in features[r["doc_id"]] & chosen)
        tails = model.tails(np.array([z]))[0]
        assert abs(r["p_above_0"] - tails[0]) < 1e-4 and abs(r["p_top"] - tails[1]) < 1e-4 and abs(r["expected_grade"] - tails.sum()) < 2e-4
        assert r["keep"] == (tails[0] >= 0.5)
