"""The labelled modelling table that the registered queries run on, derived
from lineitem, orders and customer by the same statement in both engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.workspace import exists, scratch_path

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal", "price2", "const_f"]
CATEGORICAL = ["l_linestatus", "o_orderpriority", "c_mktsegment"]
FEATURES = NUMERIC + CATEGORICAL
NOT_FEATURES = [*KEY, "yr", "hs", "hf"]
TARGET = "flag"

_SPARK_HASH = "cast(conv(substr(md5(concat_ws('|', '{salt}', {key})), 1, 8), 16, 10) as bigint)"
_DUCK_HASH = "cast('0x' || substr(md5(concat_ws('|', '{salt}', {key})), 1, 8) as bigint)"


def _statement(template: str, text: str) -> str:
    key = ", ".join(f"cast({c} as {text})" for c in KEY)

    def h(salt: str) -> str:
        return template.format(salt=salt, key=key)

    return f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_discount,
       case when {h('null')} % 20 = 0 then null else l_tax end as l_tax,
       l_linestatus, o_orderpriority, c_mktsegment, c_acctbal,
       cast(l_extendedprice * 2 as double) as price2,
       cast(1.0 as double) as const_f,
       cast(extract(year from o_orderdate) as int) as yr,
       {h('split')} as hs, {h('fold')} as hf,
       case when {h('flagnull')} % 50 = 0 then null
            when l_quantity * 2 + l_discount * 300
                 + (case when l_linestatus = 'F' then 15 else 0 end)
                 + {h('noise')} % 100 > 170 then 1 else 0 end as flag
from lineitem join orders on l_orderkey = o_orderkey
              join customer on o_custkey = c_custkey
"""


SCORED_LINES_SQL = _statement(_DUCK_HASH, "varchar")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Numeric features by the dozen: multiples of the quantity and the discount, folded back.
WIDE = {f"w{k}": f"(l_quantity * {k} + l_discount * {100 * k}) % {7 + 2 * k}" for k in range(1, 19)}


# Where the table of a folder was written, by application.
_WRITTEN: dict[tuple[str, str], str] = {}


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The modelling table, written once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key]):
        _WRITTEN[key] = scratch_path(spark, "scored_lines")
        derived_lines(spark, folder).write.parquet(_WRITTEN[key])
    return spark.read.parquet(_WRITTEN[key])


def derived_lines(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in ("lineitem", "orders", "customer")}
    # The small tables meet first and are the hashed side of both joins: lines are shuffled once and never
    # sorted. The shuffle also deals them out: a file of one row group would be hashed, and later read, by one task.
    buyers = tables["orders"].join(tables["customer"].hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    lines = tables["lineitem"].join(buyers.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    columns, _, _ = _statement(_SPARK_HASH, "string").partition("\nfrom lineitem ")
    return spark.sql(f"{columns}\nfrom {{lines}}", lines=lines)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return scored_lines(spark, folder).where("flag is not null")


def modelling_table(spark: SparkSession, folder: str, columns: Sequence[str] = (), all_rows: bool = False, wide: bool = False) -> DataFrame:
    """Labelled (or all) rows, of these columns."""
    rows = scored_lines(spark, folder) if all_rows else labelled(spark, folder)
    if wide:
        rows = rows.withColumns({name: F.round(F.expr(formula), 6) for name, formula in WIDE.items()})
    return rows.select(*columns) if columns else rows
