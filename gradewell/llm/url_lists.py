"""Which captured URLs a dated block list covered at the time of the capture.

A list is a table of dated entries: on `since`, `key` was put on the list or
taken off it. Entries of a key become validity intervals, each ending where the
next entry of the key begins. Captures meet the intervals by an as-of join: a
capture is blocked if an interval of one of its keys holds on its day. Kinds:

  host    the host itself
  domain  the host or any parent domain
  prefix  host and path up to and including a slash, or the whole path

Both sides are keyed by the month as well, so captures of one large host spread
over the months they were fetched in, and a key with many intervals is only
compared with those of the month. Everything is DataFrame functions.

Defined results: a null or unparsable URL, and a null day, match nothing; of
entries of one key and day, listing wins; entries with a null field are not
used; the match shown is the most specific (prefix, host, domain; then the
longest key, then the latest interval); each capture row gives one row, also
repeated rows; empty tables are fine; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.columns import col
from gradewell.workspace import attach, staged

KINDS = {"domain": 1, "host": 2, "prefix": 3}  # with their rank in specificity
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def url_path(url: Column) -> Column:
    """At least a slash."""
    path = F.regexp_extract(url, PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, valid_from, valid_to): when each key is listed; valid_to is null for the last entry.
    The window orders the different days of one key."""
    days = (
        entries.select("kind", "key", F.to_date("since").alias("valid_from"), col("listed").cast("boolean").alias("listed")).dropna()
        .groupBy("kind", "key", "valid_from").agg(F.max("listed").alias("listed"))
    )
    following = F.lead("valid_from").over(Window.partitionBy("kind", "key").orderBy("valid_from"))
    return days.withColumn("valid_to", following).where("listed").drop("listed")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _keys(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """(kind, key) structs under which an entry could cover a URL; no longer than the list's longest keys."""
    parts = F.split(host, r"\.")
    size = F.size(parts)
    first = F.greatest(F.lit(1), size - labels + 1)
    domains = F.transform(F.sequence(first, size), lambda i: F.array_join(F.slice(parts, i, size), "."))
    steps = F.split(path, "/")
    heads = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(steps) - 1, F.lit(slashes)))),
        lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")),
    )
    prefixes = F.array_union(heads, F.array(F.concat(host, path)))

    def of(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    return F.concat(of("host", F.array(host)), of("domain", domains), of("prefix", prefixes))


def as_of_blocks(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, fetched_col: str) -> DataFrame:
    """(id, fetched_on, host, blocked, kind, key, listed_from) of every capture."""
    listed = intervals(entries)
    depth = listed.agg(
        F.max(F.when(col("kind") == "domain", F.size(F.split("key", r"\.")))).alias("labels"),
        F.max(F.when(col("kind") == "prefix", F.size(F.split("key", "/")) - 1)).alias("slashes"),
    ).first()
    rows = captures.select(
        col(id_col).alias("id"), col(url_col).cast("string").alias("url"), F.to_date(col(fetched_col)).alias("fetched_on")
    ).withColumn("host", url_host(col("url")))
    last = rows.agg(F.max("fetched_on")).first()[0]
    # Each different URL and day is looked up once.
    asked = staged(rows.where((col("host") != "") & col("fetched_on").isNotNull()).select("url", "host", "fetched_on").distinct(), "asked")
    keyed = asked.select(
        "url", "fetched_on", _month(col("fetched_on")).alias("month"),
        F.explode(_keys(col("host"), url_path(col("url")), depth["labels"] or 0, depth["slashes"] or 0)).alias("k"),
    ).select("url", "fetched_on", "month", "k.kind", "k.key")
    ends = F.least(F.date_sub("valid_to", 1), F.lit(last).cast("date"))
    monthly = listed.where(col("valid_from") <= ends).withColumn(
        "month", F.explode(F.sequence(_month(col("valid_from")), _month(ends)))
    )
    # One row per key and month, however often it was listed; a key that many captures share, listed or not, is not shuffled.
    spans = staged(monthly.groupBy("kind", "key", "month").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("spans")), "listed")
    found = attach(keyed, spans, ["kind", "key", "month"], how="inner")
    matches = found.select("url", "fetched_on", "kind", "key", F.inline("spans")).where(
        (col("valid_from") <= col("fetched_on")) & (col("valid_to").isNull() | (col("fetched_on") < col("valid_to")))
    )
    rank = F.coalesce(*[F.when(col("kind") == kind, n) for kind, n in KINDS.items()])
    best = matches.groupBy("url", "fetched_on").agg(
        F.max(F.struct(rank.alias("rank"), F.length("key").alias("length"), "valid_from", "kind", "key")).alias("best")
    )
    return rows.join(best, ["url", "fetched_on"], "left").select(
        "id", "fetched_on", F.nullif("host", F.lit("")).alias("host"), col("best").isNotNull().alias("blocked"),
        F.col("best.kind").alias("kind"), F.col("best.key").alias("key"), F.col("best.valid_from").alias("listed_from"),
    )
