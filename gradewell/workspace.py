"""Shared storage for intermediate tables, and joins against tables of checked size."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.columns import col

# A table with at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 10_000


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gradewell-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Only a local master, where driver and executors share one machine, gets a
    folder of its own when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        folder = _local_folder()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gradewell/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has staged; call when their readers are done."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write df once as parquet in the shared folder and read it back.

    Used where several passes follow: lineage ends at the files, later passes
    read only the columns they need, and a lost executor costs its tasks only.
    `by` names a column of few values, such as a fold: passes over some of them
    read only their folders.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*[col(c) for c in df.columns]) if by else back


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables; call when what is made of them has been staged in turn."""
    for df in tables:
        context = df.sparkSession.sparkContext
        hadoop, uri = context._jvm.org.apache.hadoop.fs, context._jvm.java.net.URI
        own = hadoop.Path(_own_folder(df.sparkSession))
        files = own.getFileSystem(context._jsc.hadoopConfiguration())
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = hadoop.Path(uri(folder))
            if path.getParent().toUri().getPath() != own.toUri().getPath():
                raise ValueError(f"not a staged table: {folder}")
            files.delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """Evaluate a table now and keep it, its partitions as they are, by a reliable
    checkpoint in this application's part of the shared folder."""
    context, own = df.sparkSession.sparkContext, f"{_own_folder(df.sparkSession)}/checkpoints"
    if own not in (context.getCheckpointDir() or ""):
        context.setCheckpointDir(own)
    return df.checkpoint()


def _join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    renamed = small
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__key_{k}")
    condition = F.lit(True)
    for k in keys:
        condition = condition & col(k).eqNullSafe(col(f"__key_{k}"))
    joined = big.join(renamed, condition, how)
    return joined if how == "left_anti" else joined.drop(*[f"__key_{k}" for k in keys])


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str | None = None, how: str = "left") -> DataFrame:
    """Join `small` (one row per key) to `big`.

    Up to BROADCAST_ROWS keys: one broadcast join. Beyond that the keys that
    hold more than 1/BROADCAST_ROWS of the rows of `big` are looked up in a
    broadcast table (there can be no more than BROADCAST_ROWS of them), also if
    `small` does not have them or they are null, and only the rows of the other
    keys are shuffled. `weight` names the column of `small` that holds the rows
    of `big` per key, if it has all of them; otherwise they are counted here.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _join(big, F.broadcast(small), keys, how)
    if weight:
        counted = small.select(*[col(k) for k in keys], col(weight).alias("__rows"))
    else:
        counted = big.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("__rows"))
    total = counted.agg(F.sum("__rows")).first()[0]
    hot = pinned(counted.where(col("__rows").cast("double") * BROADCAST_ROWS >= float(total or 0)).drop("__rows"))
    if hot.isEmpty():
        return _join(big, small, keys, how)
    known = pinned(_join(hot, small, keys, how))
    hot_rows = _join(big, F.broadcast(known), keys, "inner")
    other_rows = _join(big, F.broadcast(hot), keys, "left_anti")
    return hot_rows.unionByName(_join(other_rows, small, keys, how))


def expand_copies(df: DataFrame, count: str, chunk: int = 100_000) -> DataFrame:
    """Repeat every row `count` times and drop the count.

    A row with more than `chunk` copies is first cut into pieces that are spread
    over the cluster, so no task writes out one large group alone.
    """
    others = [c for c in df.columns if c != count]
    few = (
        df.where((col(count) > 0) & (col(count) <= chunk))
        .withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), col(count).cast("bigint"))))
        .select(*[col(c) for c in others])
    )
    pieces = df.where(col(count) > chunk).withColumn(
        "__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{count}` - 1) div {chunk}")))
    )
    pieces = pieces.withColumn("__size", F.least(F.lit(chunk).cast("bigint"), col(count) - col("__piece") * chunk))
    many = (
        pieces.repartition("__piece", *[col(c) for c in others])
        .withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), col("__size"))))
        .select(*[col(c) for c in others])
    )
    return few.unionByName(many)
