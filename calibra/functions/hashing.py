"""Deterministic row order: md5 of seed and key, the same in any engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(digest: Column, start: int, digits: int) -> Column:
    """Integer from ``digits`` hex digits of a digest, 1-based ``start``."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def unit_interval(digest: Column, start: int = 1) -> Column:
    """Number in [0, 1) from eight hex digits of a digest."""
    return hash_int(digest, start, 8) / F.lit(float(16**8))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
