"""Seeded, reproducible pseudo-random draws from md5.

A draw is the first 8 hex digits of md5(seed || ':' || key) read as an
unsigned 32-bit integer and divided by 2^32: the same bits in Spark and in
DuckDB, independent of partitioning and of recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_prefix(key: Column | str, seed: int) -> Column:
    """First 32 bits of the md5 key as a bigint in [0, 2^32)."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint")


def uniform_draw(key: Column | str, seed: int) -> Column:
    """Uniform double in [0, 1); exact (division by a power of two)."""
    return hash_prefix(key, seed) / F.lit(4294967296.0)
