"""Class-based n-gram model of the corpus (Brown et al.) and its scores.

Word counts are taken over all training texts. The `CLUSTER_WORDS` most
frequent words are units of their own; every other word, seen or not, belongs
to one of `ENDINGS` units by a hash of its last two bytes. Exchange clustering
moves units between classes as long as the likelihood of the class bigrams
rises; all bigrams of units count. The probability of a word w in class c after
a word in class b is

    P(w | b) = P(c | b) * (n(w) + 0.1) / (n(c) + 0.1 * (v(c) + 1))

with v(c) the different training words of c and one more place for the unseen,
and P(c | b) the class bigrams smoothed with the class frequencies.

What the driver holds is bounded by the parameters: units, class tables, and
the words frequent enough to be among about `LOOKUP_WORDS`. The counts of all
other words stay a table; tokens that need them meet them by a shuffled join,
in which no word is frequent.

Defined results: null and empty texts hold the end token alone; a null id counts
as the empty text for the fold; without training texts every c is 0; repeated
rows are scored one by one (and counted as often as they occur); an empty table
gives no rows; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.llm.common import Cache, arrow_rows, bounded, raw_texts, small, split_words
from gradewell.workspace import staged

END = b""  # no word is empty
CLUSTER_WORDS = 1_024
ENDINGS = 256
CLASSES = 48
SWEEPS = 12
LOOKUP_WORDS = 100_000
ADD = 0.1
PRIOR = 5.0  # weight, in tokens, of the class frequencies in a class's transitions
# Different words a task counts before it hands them on.
COUNTED_WORDS = 200_000


def fold(id_col: str) -> Column:
    """True for the tenth of the ids that is held out of training."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of `texts` (one text column), the end token of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in small(batches):
            for raw in raw_texts(batch.column(0)):
                counts.update(split_words(raw))
                if len(counts) > COUNTED_WORDS:
                    yield out()
                    counts = Counter()
            counts[END] += batch.num_rows
        yield out()

    return bounded(texts).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(col("n") > 0)


@dataclass
class Units:
    """Which unit a word belongs to: 0 the end token, then frequent words, then endings."""

    frequent: dict[bytes, int]

    @property
    def size(self) -> int:
        return 1 + len(self.frequent) + ENDINGS

    def of(self, word: bytes) -> int:
        if word == END:
            return 0
        own = self.frequent.get(word)
        return own if own is not None else 1 + len(self.frequent) + zlib.crc32(word[-2:]) % ENDINGS


def unit_bigrams(texts: DataFrame, units: Units) -> np.ndarray:
    """How often unit i is followed by unit j, the end token also standing before each text."""
    size = units.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(units.of)
        total = np.zeros(size * size, np.int64)
        for batch in small(batches):
            row: list[np.ndarray] = [np.zeros(1, np.int64)]
            for raw in raw_texts(batch.column(0)):
                words = split_words(raw)
                row += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
            line = np.concatenate(row)
            total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": total[pairs]})

    pairs = texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size * size)
    counts[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    return counts.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every unit, unit 0 alone in class 0. Units go, most frequent
    first, to the class in which the bigram likelihood is largest, until a sweep moves none."""
    n = len(bigrams)
    left, right = bigrams.sum(1), bigrams.sum(0)
    order = np.argsort(-(left + right), kind="stable")
    order = order[order != 0]
    of = np.zeros(n, np.int64)
    free = max(1, classes - 1)
    of[order] = 1 + np.arange(n - 1) % free
    member = np.zeros((n, 1 + free))
    member[np.arange(n), of] = 1
    to, frm = bigrams @ member, bigrams.T @ member  # of every unit, to and from every class
    table = member.T @ to
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not left[u] and not right[u]:
                continue
            old, self_count = of[u], bigrams[u, u]
            out, inn = to[u].copy(), frm[u].copy()
            out[old] -= self_count
            inn[old] -= self_count
            table[old, :] -= out
            table[:, old] -= inn
            table[old, old] -= self_count
            gain = (_f(table + out) - _f(table)).sum(1) + (_f(table + inn[:, None]) - _f(table)).sum(0)
            own = np.diagonal(table)
            gain += _f(own + out + inn + self_count) - _f(own + out) - _f(own + inn) + _f(own)
            starts, ends = table.sum(1), table.sum(0)
            gain -= _f(starts + left[u]) - _f(starts) + _f(ends + right[u]) - _f(ends)
            gain[0] = -np.inf  # the end token's class
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new, :] += out
            table[:, new] += inn
            table[new, new] += self_count
            if new != old:
                of[u], moved = new, moved + 1
                to[:, old] -= bigrams[:, u]
                to[:, new] += bigrams[:, u]
                frm[:, old] -= bigrams[u, :]
                frm[:, new] += bigrams[u, :]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    units: Units
    of_unit: np.ndarray  # class of every unit
    transition: np.ndarray  # log10 P(class | class before)
    class_total: np.ndarray  # log10(n(c) + ADD * (v(c) + 1))
    known: dict[bytes, int]  # counts of the looked-up words
    tokens: int
    base_total: float  # log10(N + ADD * (V + 1))


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words above the lowest power of two that at most `most` words reach."""
    level = F.floor(F.log2(col("n"))).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).count().collect())  # at most 63 rows
    total, lowest = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        lowest = k
    if lowest is None:
        return {}
    found = counts.where(level >= lowest).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))


def fit_classes(
    texts: DataFrame, counts: DataFrame, cluster_words: int = CLUSTER_WORDS, classes: int = CLASSES, lookup_words: int = LOOKUP_WORDS
) -> ClassModel:
    """Fit on `texts` (one text column) and their staged word_counts."""
    known = _frequent(counts, lookup_words)
    ranked = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))[:cluster_words]
    units = Units({w: 1 + i for i, w in enumerate(ranked)})
    bigrams = unit_bigrams(texts, units)
    of_unit = exchange_classes(bigrams, classes)
    n_classes = int(max(classes, of_unit.max() + 1))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(n_classes, np.int64), np.zeros(n_classes, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            cls = of_unit[np.fromiter((units.of(w) for w in words), np.int64, len(words))]
            np.add.at(n, cls, batch.column(1).to_numpy())
            v += np.bincount(cls, minlength=n_classes)
        yield pa.RecordBatch.from_pydict({"c": np.arange(n_classes), "n": n, "v": v})

    n, v = np.zeros(n_classes), np.zeros(n_classes)
    for row in counts.mapInArrow(sizes, "c bigint, n bigint, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[row["c"]], v[row["c"]] = row["n"], row["v"]
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, (of_unit[:, None], of_unit[None, :]), bigrams)
    share = (n + 0.5) / (n + 0.5).sum()
    transition = (table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR)
    return ClassModel(
        units, of_unit, np.log10(transition), np.log10(n + ADD * (v + 1)), known, int(n.sum()), float(np.log10(n.sum() + ADD * (v.sum() + 1)))
    )


PARTS = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_part double, score_part double, "
    "rare array<struct<word: binary, times: bigint>>"
)


def _parts(df: DataFrame, model: ClassModel) -> DataFrame:
    """Scores without the counts of words outside the look-up, and those words."""
    log_count = {w: float(np.log10(n + ADD)) for w, n in model.known.items()}
    unseen_end = float(np.log10(ADD))

    def task():
        of = Cache(lambda w: (int(model.of_unit[model.units.of(w)]), log_count.get(w)))
        end_log = log_count.get(END, unseen_end)
        # The end token may be too rare for the look-up only where there are very few texts.
        end_known = END in log_count

        def rows(batch: pa.RecordBatch) -> dict:
            tokens, known, base, score, rare = [], [], [], [], []
            for raw in raw_texts(batch.column(3)):
                words = split_words(raw)
                found = [of[w] for w in words]
                cls = np.fromiter((c for c, _ in found), np.int64, len(found))
                line = np.concatenate([[0], cls, [0]])
                missing = Counter(w for w, (_, x) in zip(words, found) if x is None)
                if not end_known:
                    missing[END] += 1
                logs = sum(x for _, x in found if x is not None) + (end_log if end_known else 0.0)
                n = len(words) + 1
                tokens.append(n)
                known.append(n - sum(missing.values()))
                base.append(logs - n * model.base_total)
                score.append(logs + float(model.transition[line[:-1], line[1:]].sum() - model.class_total[line[1:]].sum()))
                rare.append([{"word": w, "times": t} for w, t in missing.items()])
            return {
                "row": batch.column(0), "doc_id": batch.column(1), "held_out": batch.column(2), "n_tokens": tokens, "n_known": known,
                "base_part": base, "score_part": score, "rare": rare,
            }

        return rows

    return arrow_rows(df, task, PARTS)


def score_texts(df: DataFrame, model: ClassModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    source = df.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("bigint").alias("doc_id"), fold(id_col).alias("held_out"),
        col(text_col).cast("string").alias("text"),
    )
    parts = staged(_parts(source, model), "lm-parts")
    rare = parts.select("row", F.inline("rare")).join(counts, "word", "left")
    log = col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)
    more = rare.groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(col("n").isNotNull(), col("times")).otherwise(0)).alias("seen"))
    joined = parts.drop("rare").join(more, "row", "left")
    extra = F.coalesce("log", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), (col("base_part") + extra).alias("base_score"),
        (col("score_part") + extra).alias("score"),
        F.pow(F.lit(10.0), -(col("score_part") + extra) / col("n_tokens")).alias("perplexity"),
    )


def class_lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Fit on the texts that are not held out, score all."""
    train = df.where(~fold(id_col)).select(col(text_col).cast("string").alias("text"))
    counts = staged(word_counts(train), "word-counts")
    return score_texts(df, fit_classes(train, counts, **settings), counts, id_col, text_col)
