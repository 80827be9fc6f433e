"""Row-local pseudo-random numbers: the same row gets the same number in any
partitioning, on any retry, and in any engine that has md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.columns import col

HASH_SPAN = 1 << 32


def row_hash(key: Sequence[str], salt: object) -> Column:
    """First 32 bits of md5(salt|key...), as a long in [0, 2^32)."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("\\N")) for c in key]
    digest = F.md5(F.concat_ws("|", F.lit(str(salt)), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_hash(key: Sequence[str], salt: object) -> Column:
    """The same number scaled to [0, 1)."""
    return row_hash(key, salt) / F.lit(float(HASH_SPAN))
