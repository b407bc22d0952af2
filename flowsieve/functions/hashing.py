"""Seeded pseudo-random numbers that depend on the row key alone, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(key: list[str] | list[Column], seed: int, portable: bool = False) -> Column:
    """Uniform 60-bit integer of the key columns.

    The default is xxhash64. ``portable`` takes the first 15 hex digits of an md5 instead, which
    other engines compute too, so that a split can be repeated or checked outside Spark.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    if portable:
        text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 64 - HASH_BITS)


def unit(h: Column) -> Column:
    """A 60-bit hash as a fraction in [0, 1)."""
    return h / F.lit(float(1 << HASH_BITS))
