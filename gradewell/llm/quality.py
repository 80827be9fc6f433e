"""Quality grades of documents by ordinal cumulative-link regression.

P(grade > k) = 1 / (1 + exp(threshold_k - w . x)): one weight per text feature,
shared by all grades, and ordered thresholds. x says which of `FEATURES` hashed
features a text has; the features are words without the punctuation around them
and the runs of signs that end words. They are chosen on the training rows by
the likelihood ratio of their presence against the grades, so that the thousands
of neutral words of a long text add nothing.

The fit uses at most `sample_rows` labelled rows (a documented bound), those
first in the order of a hash of their id. Scoring is row-local and takes whole
texts. A text is kept when P(grade > 0) is at least one half.

Defined results: null and empty texts have no features and get the grade of the
thresholds alone; label rows without an id, or without both labels, are not
used; of several labels of a document the lowest grade counts; without usable
labels grades and probabilities are null and every text is kept; each row gives
one row; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import Cache, arrow_filter, arrow_rows, hash64, raw_texts, split_words
from gradewell.workspace import staged

SAMPLE_ROWS = 20_000
FEATURES = 4_096
# Rows that must have a feature before it is considered.
LEAST_ROWS = 3
# Twice the log likelihood ratio that a feature must reach.
LEAST_RATIO = 15.0
# Bytes of the beginnings of words that are features: inflected forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)
DENSITIES = (1 / 300, 1 / 80, 1 / 20)
RIDGE = 0.3
STEPS = 400

MASK = (1 << 61) - 1
SIGNS = rb"!-/:-@\[-`{-~"
AROUND = re.compile(rb"^[" + SIGNS + rb"]+|[" + SIGNS + rb"]+$")
LAST = re.compile(rb"[" + SIGNS + rb"]+$")


def word_features(word: bytes) -> tuple[int, ...]:
    """61-bit hashes of the bare word, its beginnings of some lengths, and the signs at its end."""
    out = []
    if bare := AROUND.sub(b"", word):
        out.append(hash64(bare, 1) & MASK)
        out += [hash64(bare[:n], 3) & MASK for n in BEGINNINGS if n < len(bare)]
    if found := LAST.search(word):
        out.append(hash64(found.group(), 2) & MASK)
    return tuple(out)


def text_features(raw: bytes, of_word) -> set[int]:
    """The features of the words of a text, and apart from them those that come twice
    and at least as often, per word, as each of `DENSITIES`."""
    words = split_words(raw)
    times: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for f in of_word[word]:
            times[f] += n
    found = set(times)
    for level, share in enumerate(DENSITIES, 1):
        least = max(2.0, share * len(words))
        found.update(f + (level << 61) for f, n in times.items() if n >= least)
    return found


@dataclass
class OrdinalModel:
    weights: dict[int, float]
    thresholds: list[float]  # ascending, one fewer than grades; empty: nothing was learnt

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, a column each."""
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.thresholds)[None, :] - z[:, None], -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights, by Adam with full gradients. rows: the features of each text."""
    if not len(grades):
        return OrdinalModel({}, [])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, column = np.unique(np.concatenate(rows), return_inverse=True)
    n, m = len(rows), len(names)
    share = np.clip([(grades <= k).mean() for k in range(levels - 1)], 0.5 / n, 1 - 0.5 / n)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))  # thresholds: the first, then positive steps
    params = np.concatenate([np.zeros(m), start[:1], gaps])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    rise = 1 if levels > 1 else 0
    for step in range(1, STEPS + 1):
        weight, theta = params[:m], np.cumsum(np.concatenate([params[m : m + rise], np.exp(params[m + 1 :])]))
        z = np.bincount(owner, weight[column], n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            below, above = 1 / (1 + np.exp(z - edge[grades])), 1 / (1 + np.exp(z - edge[grades + 1]))
        mass = np.maximum(above - below, 1e-12)
        slope_low, slope_high = below * (1 - below) / mass, above * (1 - above) / mass
        by_z = (slope_high - slope_low) / n  # of the negative log likelihood
        grad_w = np.bincount(column, by_z[owner], m) + RIDGE * weight / n
        by_theta = np.array([(slope_low[grades == k + 1].sum() - slope_high[grades == k].sum()) / n for k in range(levels - 1)])
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * np.exp(params[m + 1 :])])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        params = params - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    theta = np.cumsum(np.concatenate([params[m : m + rise], np.exp(params[m + 1 :])]))
    return OrdinalModel(dict(zip(names.tolist(), params[:m].tolist())), theta.tolist())


def fit_quality(
    docs: DataFrame, labels: DataFrame, grade: Column, levels: int, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
) -> OrdinalModel:
    """Fit on a bounded sample of `labels`, whose column expression `grade` gives 0 to levels - 1 or null."""
    rated = labels.select(col(label_id).cast("bigint").alias("id"), grade.cast("int").alias("grade")).dropna()
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # at most sample_rows narrow rows are broadcast
    texts = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "id")
    # An id has one label and is one row of the fit, however many rows it has: the text with the smallest hash.
    joined = joined.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def task():
        of_word = Cache(word_features)

        def rows(batch: pa.RecordBatch) -> dict:
            found = [np.fromiter(text_features(raw, of_word), np.int64) for raw in raw_texts(batch.column(2))]
            return {"id": batch.column(0), "grade": batch.column(1), "features": found}

        return rows

    table = staged(arrow_rows(joined, task, "id bigint, grade int, features array<bigint>"), "features")
    sizes = {r["grade"]: r["count"] for r in table.groupBy("grade").count().collect()}
    if not sizes:
        return OrdinalModel({}, [])
    chosen = choose_features(table, [sizes.get(k, 0) for k in range(levels)])
    kept = table.select("id", "grade", F.array_sort(F.array_intersect("features", F.lit(chosen).cast("array<bigint>"))).alias("features")).toArrow()
    kept = kept.sort_by("id")
    rows = [np.asarray(x, np.int64) for x in kept.column("features").to_numpy()]
    return fit_ordinal(rows, kept.column("grade").to_numpy().astype(np.int64), levels)


def choose_features(table: DataFrame, sizes: list[int]) -> list[int]:
    """For every threshold the features that are more frequent below it, with the
    largest likelihood ratio (a G statistic) of presence against below or above."""
    total, share = sum(sizes), FEATURES // max(1, len(sizes) - 1)
    present = table.select("grade", F.explode("features").alias("f")).groupBy("f").agg(
        F.count("*").alias("has"), *[F.count_if(col("grade") <= k).alias(f"low{k}") for k in range(len(sizes) - 1)]
    )
    present = staged(present.where(col("has") >= LEAST_ROWS), "presence")

    def part(found: Column, expected: Column) -> Column:
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    chosen: set[int] = set()
    for k in range(len(sizes) - 1):
        below, low, has = sum(sizes[: k + 1]), col(f"low{k}"), col("has")
        p = below / total
        if not 0 < p < 1:
            continue
        ratio = 2 * (part(low, has * p) + part(has - low, has * (1 - p)) + part(below - low, (total - has) * p)
                     + part(total - below - has + low, (total - has) * (1 - p)))
        ranked = present.where(low > has * p).select("f", ratio.alias("ratio")).where(col("ratio") >= LEAST_RATIO)
        chosen.update(r["f"] for r in ranked.orderBy(F.desc("ratio"), "f").limit(share).collect())
    return sorted(chosen)


def _scorer(model: OrdinalModel):
    used = {f & MASK for f in model.weights}
    of_word = Cache(lambda w: tuple(f for f in word_features(w) if f in used))

    def score(texts: list[bytes]) -> np.ndarray:
        z = [sum(model.weights.get(f, 0.0) for f in sorted(text_features(raw, of_word))) for raw in texts]
        return model.tails(np.array(z, float))

    return score


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_above_0, p_top, keep) of every row."""
    schema = "doc_id bigint, expected_grade double, p_above_0 double, p_top double, keep boolean"
    source = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))

    def task():
        score = _scorer(model)

        def rows(batch: pa.RecordBatch) -> dict:
            if not model.thresholds:
                nothing = [None] * batch.num_rows
                return {"doc_id": batch.column(0), "expected_grade": nothing, "p_above_0": nothing, "p_top": nothing, "keep": [True] * batch.num_rows}
            tails = score(raw_texts(batch.column(1)))
            return {
                "doc_id": batch.column(0), "expected_grade": tails.sum(1), "p_above_0": tails[:, 0], "p_top": tails[:, -1],
                "keep": tails[:, 0] >= 0.5,
            }

        return rows

    return arrow_rows(source, task, schema)


def keep_good(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The documents whose P(grade > 0) is at least one half, rows and columns unchanged."""
    if not model.thresholds:
        return docs
    at = docs.columns.index(text_col)

    def task():
        score = _scorer(model)
        return lambda batch: (score(raw_texts(batch.column(at)))[:, 0] >= 0.5).tolist()

    return arrow_filter(docs, task)
