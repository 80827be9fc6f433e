import datetime

from pyspark.sql import types as T

from catalog.fixture import derived_lines


def tables(spark, folder, lines, orders, customers):
    """Small tables with the columns that the modelling table reads."""
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
    ])).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")


def test_lines_are_shuffled_once_and_not_sorted(spark, tmp_path):
    """Null, repeated and unknown keys join as in SQL."""
    day = datetime.datetime(1995, 3, 1)
    tables(
        spark, tmp_path,
        [(key, n, 1, 1, 10.0, 100.0, 0.1, 0.0, "F") for key, n in [(1, 1), (1, 1), (2, 1), (None, 1), (9, 1)]],
        [(1, 5, day, "a"), (1, 6, day, "b"), (2, None, day, "c"), (None, 5, day, "d"), (2, 5, day, "e")],
        [(5, "x", 1.0), (5, "y", 2.0), (None, "z", 3.0), (6, None, None)],
    )
    rows = derived_lines(spark, str(tmp_path))
    found = sorted(tuple(map(str, r)) for r in rows.select("l_orderkey", "o_orderpriority", "c_mktsegment", "yr").collect())
    assert found == sorted(
        2 * [("1", "a", "x", "1995"), ("1", "a", "y", "1995"), ("1", "b", "None", "1995")] + [("2", "e", "x", "1995"), ("2", "e", "y", "1995")]
    )
    plan = derived_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and plan.count("Exchange") == 4
