"""Deterministic draws: every random choice is a hash of a documented key, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_int(*parts: Column) -> Column:
    """The first eight hex digits of the key's md5 as a number under 2**32."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts: Column) -> Column:
    return hash_int(*parts) / F.lit(float(1 << 32))
