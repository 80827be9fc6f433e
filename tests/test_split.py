from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog.fixture import KEY
from gradewell import workspace
from gradewell.operators.split import (
    fold_hash, kfold_assign, split_except_all, split_exact, split_hash, strata_distinct, strata_key, train_val_split,
)
from gradewell.workspace import attach, expand_copies


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_hash_split_is_a_partition_and_does_not_depend_on_layout(lines):
    rows = lines.select(*KEY)
    one = counted(split_hash(rows, KEY, 0.8, 7))
    assert one == counted(split_hash(rows.repartition(7), KEY, 0.8, 7))
    parts = Counter(r[-1] for r in one.elements())
    assert sum(parts.values()) == rows.count() and abs(parts["train"] / rows.count() - 0.8) < 0.02
    assert one != counted(split_hash(rows, KEY, 0.8, 8))
    assert 0 < train_val_split(rows, KEY, 0.05, 1).where("is_val").count() < 500


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.9, 1.0])
def test_exact_split_hits_every_stratum(lines, fraction):
    rows = lines.select(*KEY, "yr", "flag")  # flag holds nulls: a stratum of its own
    parts = split_exact(rows, ["yr", "flag"], fraction, 3, KEY)
    assert counted(parts.drop("split")) == counted(rows)
    got = parts.groupBy("yr", "flag").agg(F.count_if(F.col("split") == "train").alias("t"), F.count("*").alias("n")).collect()
    assert len(got) == 21 and all(r.t == int(r.n * fraction + 0.5) for r in got)


def test_exact_split_ranks_like_a_window(lines):
    rows = lines.select(*KEY, "l_linestatus")
    parts = split_exact(rows, ["l_linestatus"], 0.37, 5).toPandas()
    from gradewell.functions import row_hash
    ranked = rows.withColumn("h", row_hash(rows.columns, 5)).toPandas().sort_values(["l_linestatus", "h", *KEY])
    for status, group in ranked.groupby("l_linestatus"):
        want = group.head(int(round(len(group) * 0.37)))[KEY].apply(tuple, axis=1)
        have = parts[(parts.l_linestatus == status) & (parts.split == "train")][KEY].apply(tuple, axis=1)
        assert Counter(want) == Counter(have)


@pytest.mark.parametrize("fraction,train", [(0.1, 100), (0.5, 500), (0.93, 930)])
def test_copies_are_divided(spark, fraction, train):
    hot = spark.range(600).selectExpr("cast(0 as bigint) as id", "'c' as v")
    rows = hot.unionAll(spark.range(1, 401).selectExpr("id", "'u' as v"))
    parts = split_exact(rows, [], fraction, 1)
    assert counted(parts.drop("split")) == counted(rows)
    assert parts.where("split = 'train'").count() == train


def test_one_key_with_many_contents_is_divided(spark):
    rows = spark.range(1000).selectExpr("cast(if(id < 400, 0, id) as bigint) as k", "id as v")
    folds = kfold_assign(rows, [], 7, 1, key=["k"])
    assert counted(folds.drop("fold")) == counted(rows)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_folds(lines):
    rows = lines.where("flag is not null").select(*KEY, "flag")
    sizes = kfold_assign(rows, "flag", 3, "fold", KEY).groupBy("flag", "fold").count().collect()
    for flag in (0, 1):
        mine = [r["count"] for r in sizes if r.flag == flag]
        assert len(mine) == 3 and max(mine) - min(mine) <= 1
    assert {r.fold for r in fold_hash(rows, KEY, 4, 0).select("fold").distinct().collect()} == {0, 1, 2, 3}
    assert kfold_assign(rows.limit(0), "flag", 3, 0).count() == 0


def test_strata_keep_nulls_apart(spark):
    df = spark.createDataFrame(
        [(1, "a", None, 0), (2, None, "a", 0), (3, "a", "b", 1), (4, "a_b", None, 1), (4, "a_b", None, 1)], "id int, x string, y string, t int"
    )
    assert {tuple(r) for r in strata_key(df, ["x", "y"]).collect()} == {("a", None, 1), (None, "a", 1), ("a", "b", 1), ("a_b", None, 2)}
    assert strata_distinct(df, ["x", "y"]).count() == 4
    got = split_exact(df, ["x", "y"], 0.5, 0).where("split = 'train'").groupBy("x", "y").count().collect()
    assert Counter(r["count"] for r in got) == Counter({1: 4})  # halves round up


def test_except_all(spark):
    a = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (3, "y")], "i int, s string")
    b = spark.createDataFrame([(1, None), (3, "y"), (9, "z")], "i int, s string")
    assert counted(split_except_all(a, b)) == counted(a.exceptAll(b))


def test_expand_copies_in_pieces(spark):
    df = spark.createDataFrame([("a", 10), ("b", 3), ("c", 0), ("d", 1)], "v string, n bigint")
    assert counted(expand_copies(df, "n", chunk=3)) == Counter({("a",): 10, ("b",): 3, ("d",): 1})


def test_attach_with_more_keys_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 5)
    big = spark.range(300).selectExpr("if(id < 150, null, cast(id % 20 as string)) as k", "id")
    small = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.coalesce("k", F.lit("none"))).where("k is null or k <> '7'")
    got = {r.id: r.w for r in attach(big, small, ["k"], "n").collect()}
    want = {r.id: ("none" if r.k is None else (None if r.k == "7" else r.k)) for r in big.collect()}
    assert got == want
    inner = attach(big, small, ["k"], "n", "inner").collect()
    assert {r.id for r in inner} == {i for i, w in want.items() if w is not None}


def test_exact_split_with_many_strata(lines, monkeypatch):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 3)
    rows = lines.select(*KEY, "yr", "flag")
    got = split_exact(rows, ["yr", "flag"], 0.5, 3, KEY)
    assert counted(got.drop("split")) == counted(rows)
    assert all(r.t == int(r.n * 0.5 + 0.5) for r in got.groupBy("yr", "flag").agg(
        F.count_if(F.col("split") == "train").alias("t"), F.count("*").alias("n")).collect())
