import pytest
from pyspark.sql import types as T

from gradewell import Roles
from gradewell.columns import (
    as_number, classify_columns, drop_null_target, feature_columns, feature_names, nullable_schema, positive_label,
)
from gradewell.operators.checks import (
    class_distribution, column_types, constant_filter, not_null_check, row_shape, unique_key_check,
)


def typed(spark):
    return spark.createDataFrame([], T.StructType([
        T.StructField("b", T.ByteType()), T.StructField("i", T.IntegerType(), False), T.StructField("l", T.LongType()),
        T.StructField("d", T.DoubleType()), T.StructField("m", T.DecimalType(10, 2)), T.StructField("s", T.StringType()),
        T.StructField("o", T.BooleanType()), T.StructField("t", T.DateType()), T.StructField("a", T.ArrayType(T.IntegerType())),
    ]))


def test_classify(spark):
    df = typed(spark)
    assert classify_columns(df, ["b", "s", "i", "l", "o", "d", "m"]) == (["b", "i", "l", "d", "m"], ["s", "o"])
    for bad in ("t", "a"):
        with pytest.raises(TypeError, match=f"'{bad}'"):
            classify_columns(df, ["i", bad])


def test_features_are_all_but_excluded(spark):
    df = typed(spark)
    exclude = ["t", "a"]
    assert feature_names(df, exclude, "i") == ["b", "l", "d", "m", "s", "o"]
    assert exclude == ["t", "a"]  # the caller's list is not changed
    assert feature_columns(df, ["t", "a", "i"]).columns == Roles("i", exclude=exclude).features(df)
    with pytest.raises(ValueError, match="nope.*present: \\['t'\\]"):
        feature_names(df, ["t", "nope"])


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1)], "`a.b c` double, y int")
    assert not_null_check(df, ["a.b c", "y"]).collect() == [("a.b c", 1)]
    assert feature_columns(df, ["y"]).columns == ["a.b c"]


def test_nullable_schema(spark):
    schema = nullable_schema(typed(spark))
    assert all(f.nullable for f in schema) and schema.names == typed(spark).columns


def test_labels(spark):
    df = spark.createDataFrame([("bad",), ("good",), (None,)], "t string")
    assert [r.label for r in positive_label(df, "t", "bad").collect()] == [1.0, 0.0, None]
    assert drop_null_target(df, "t").count() == 2


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r.x for r in df.select(as_number(df, "x").alias("x")).collect()] == [None, 1.0, None]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0), (2, None, None), (3, "long", 5.0)], "k1 int, k2 string, v double")
    assert sorted(unique_key_check(df, ["k1", "k2"]).collect(), key=str) == [(1, "a", 2), (2, None, 1)]
    assert not_null_check(df, ["k1", "k2", "v"]).collect() == [("k2", 1), ("v", 1)]
    assert not_null_check(df, ["k1"]).count() == 0
    assert column_types(df, ["k2", "k1"]).collect() == [("k2", "string", True, 4), ("k1", "int", True, None)]
    with pytest.raises(ValueError):
        column_types(df, ["none"])
    assert {tuple(r) for r in class_distribution(df, "k1").collect()} == {(1, 2), (2, 1), (3, 1)}
    assert row_shape(df).collect() == [(4, 3)]
    assert constant_filter(df, ["k1", "v"]).count() == 0  # a null beside one value is a second value
    assert [r.feature for r in constant_filter(df.na.drop(), ["k1", "v"]).collect()] == ["v"]
    assert row_shape(df.limit(0)).collect() == [(0, 3)]
