"""Reproducible splits and folds.

The hash forms decide each row from its own key: no shuffle, the same answer
under any partitioning or retry. The exact forms hit the wanted counts per
stratum to the row; they find the few cut positions by counting, then decide
each row by comparing it with the cuts, so rows are never sorted or ranked.

Rows that are complete copies of each other always land on the same side in
the hash forms; the exact forms divide a group of copies where a cut falls
inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.functions.hashing import row_hash, unit_hash
from gradewell.workspace import attach, expand_copies, pinned

# The upper 16 of the 32 hash bits name the counting bucket.
_BUCKET_SHIFT = 16


def split_hash(df: DataFrame, key: Sequence[str], fraction: float, seed: object, out: str = "split",
               names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Bernoulli split by key hash. One fraction for all strata, so strata keep
    their proportions in expectation and need not be known."""
    first, second = names
    return df.withColumn(out, F.when(unit_hash(key, seed) < F.lit(float(fraction)), F.lit(first)).otherwise(F.lit(second)))


def train_val_split(df: DataFrame, key: Sequence[str], val_size: float, seed: object, out: str = "is_val") -> DataFrame:
    """Boolean validation flag for a model search."""
    return df.withColumn(out, unit_hash(key, seed) >= F.lit(1.0 - float(val_size)))


def fold_hash(df: DataFrame, key: Sequence[str], folds: int, seed: object, out: str = "fold") -> DataFrame:
    """k folds by key hash: row-local, class shares hold in expectation."""
    return df.withColumn(out, F.pmod(row_hash(key, seed), F.lit(folds)).cast("int"))


def split_exact(df: DataFrame, strata: Sequence[str], fraction: float, seed: object,
                key: Sequence[str] | None = None, out: str = "split",
                names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """round(fraction * n) rows of every stratum go to the first part: those
    that come first by (key hash, key)."""
    first, second = names
    parts = _parts_by_rank(df, strata, key, seed, lambda n: F.array(F.round(n * F.lit(float(fraction))).cast("bigint")))
    return (
        parts.withColumn(out, F.when(col("__part") == 0, F.lit(first)).otherwise(F.lit(second))).drop("__part")
    )


def kfold_assign(df: DataFrame, label: str | Sequence[str], folds: int, seed: object,
                 key: Sequence[str] | None = None, out: str = "fold") -> DataFrame:
    """Stratified folds of equal size (to one row) within each class: fold i is
    the i-th of k consecutive runs of the class ordered by (key hash, key)."""
    strata = [label] if isinstance(label, str) else list(label)

    def ends(n: Column) -> Column:
        extra = F.pmod(n, F.lit(folds).cast("bigint"))
        size = (n - extra) / F.lit(folds)
        return F.array(*[
            size.cast("bigint") * i + F.least(extra, F.lit(i).cast("bigint")) for i in range(1, folds)
        ])

    return _parts_by_rank(df, strata, key, seed, ends).withColumnRenamed("__part", out)


def _parts_by_rank(df: DataFrame, strata: Sequence[str], key: Sequence[str] | None, seed: object,
                   ends: Callable[[Column], Column]) -> DataFrame:
    """Add __part: how many of the cumulative counts `ends(n)` of its stratum a
    row's rank by (hash, key) exceeds. `key` defaults to all columns."""
    columns = df.columns
    key = list(key) if key else columns
    by = [f"__s{i}" for i in range(len(strata))] or ["__s0"]
    values = [col(c) for c in strata] or [F.lit(0)]
    at = F.struct(col("__h"), *[col(c).alias(f"k{i}") for i, c in enumerate(key)])
    rows = df.withColumn("__h", row_hash(key, seed)).withColumns(dict(zip(by, values))).withColumn("__at", at)

    cuts = pinned(_cuts(rows.select(*by, "__h", "__at"), by, ends))
    marked = attach(rows, cuts, by, "__total")
    below = F.size(F.filter("__ends", lambda e: e <= 0))
    passed = F.size(F.filter("__cuts", lambda c: c["at"] < col("__at")))
    marked = marked.withColumn("__part", below + passed)
    result = [*[col(c) for c in columns], col("__part")]
    if cuts.where(F.exists("__cuts", lambda c: c["end"] < c["stop"])).isEmpty():
        return marked.select(*result)

    # Some cut falls inside a group of rows with one key: divide those groups apart.
    mine = F.filter("__cuts", lambda c: (c["at"] == col("__at")) & (c["end"] < c["stop"]))
    marked = marked.withColumn("__tie", mine)
    clear = marked.where(F.size("__tie") == 0).select(*result)
    groups = marked.where(F.size("__tie") > 0).withColumn(
        "__left", F.transform("__ends", lambda e: e - col("__tie")[0]["start"])
    ).select(*[col(c) for c in columns], "__left")
    content = [c for c in columns if c != "__left"]
    if set(key) != set(content):
        left = f"__s{len(strata)}"
        divided = _parts_by_rank(groups, [*strata, "__left"], content, f"{seed}/ties", lambda n: col(left))
    else:
        divided = _divide_copies(groups, content)
    return clear.unionByName(divided.select(*result))


def _cuts(rows: DataFrame, by: list[str], ends: Callable[[Column], Column]) -> DataFrame:
    """One row per stratum: __total rows, wanted __ends, and __cuts, the
    (hash, key) at which each end is reached with the ranks start..stop it spans."""
    rows = rows.withColumn("__b", F.shiftright("__h", _BUCKET_SHIFT))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by)
    counts = pinned(
        counts.withColumn("__total", F.sum("__n").over(whole))
        .withColumn("__upto", F.sum("__n").over(whole.orderBy("__b")))
        .withColumn("__ends", ends(col("__total")))
        .withColumn("__wanted", F.filter("__ends", lambda e: (e > col("__upto") - col("__n")) & (e <= col("__upto"))))
        .where((F.size("__wanted") > 0) | (col("__upto") == col("__total")))
    )
    hit = counts.where(F.size("__wanted") > 0).select(
        *by, "__b", "__n", "__wanted", (col("__upto") - col("__n")).alias("__before")
    )
    # Only the rows of those buckets are counted key by key.
    near = attach(rows, hit, [*by, "__b"], "__n", "inner").groupBy(*by, "__b", "__at").agg(
        F.count("*").alias("__m"), F.first("__wanted").alias("__wanted"), F.first("__before").alias("__before")
    )
    running = F.sum("__m").over(Window.partitionBy(*by, "__b").orderBy("__at"))
    found = (
        near.withColumn("__stop", col("__before") + running)
        .withColumn("__start", col("__stop") - col("__m"))
        .select(*by, "__at", "__start", "__stop", F.explode("__wanted").alias("__end"))
        .where((col("__end") > col("__start")) & (col("__end") <= col("__stop")))
        .withColumn("__cut", F.struct(
            col("__end").alias("end"), col("__at").alias("at"), col("__start").alias("start"), col("__stop").alias("stop")
        ))
    )
    strata = counts.where(col("__upto") == col("__total")).select(*by, "__total", "__ends", F.lit(None).alias("__cut"))
    return (
        strata.unionByName(found.select(*by, "__cut"), allowMissingColumns=True)
        .groupBy(*by)
        .agg(F.max("__total").alias("__total"), F.max("__ends").alias("__ends"), F.collect_list("__cut").alias("__cuts"))
    )


def _divide_copies(groups: DataFrame, content: list[str]) -> DataFrame:
    """Hand out complete copies by number: they are counted, never ranked."""
    counted = groups.groupBy(*[col(c) for c in groups.columns]).agg(F.count("*").alias("__m"))
    zero = F.lit(0).cast("bigint")
    bounds = F.concat(
        F.array(zero), F.transform("__left", lambda e: F.greatest(zero, F.least(e, col("__m")))), F.array(col("__m"))
    )
    sizes = F.transform(F.sequence(F.lit(1), F.size("__left") + 1), lambda i: col("__bounds")[i] - col("__bounds")[i - 1])
    parts = (
        counted.withColumn("__bounds", bounds)
        .select(*[col(c) for c in content], "__left", F.posexplode(sizes).alias("__part", "__copies"))
    )
    return expand_copies(parts, "__copies")


def strata_key(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per stratum, keyed by the columns themselves: a joined text key
    would merge ('a', null) with (null, 'a') and ('a', 'b') with ('a_b', null)."""
    return df.groupBy(*[col(c) for c in strata]).agg(F.count("*").alias("n"))


def strata_distinct(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in strata]).distinct()


def split_except_all(df: DataFrame, part: DataFrame) -> DataFrame:
    """Multiset difference df - part (EXCEPT ALL), columns matched by name."""
    return df.exceptAll(part.select(*[col(c) for c in df.columns]))
