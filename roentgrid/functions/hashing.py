"""Deterministic pseudo-random order and draws from hashes of row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed, *cols) -> Column:
    """md5 of the seed and key columns: sorting by it is a reproducible shuffle."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[p.cast("string") for p in parts]))


def hash_bucket(order: Column, digits: int = 4) -> Column:
    """Leading hex digits: equal-sized buckets that keep the hash order."""
    return F.substring(order, 1, digits)


def hash_int(order: Column) -> Column:
    """First 60 bits of a hash as a non-negative bigint."""
    return F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint")


def example_id(*cols) -> Column:
    """Stable id of a natural key."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
