"""Keyed hashes for order-free, engine-independent sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int | str) -> Column:
    """A number in [0, 1): the first 60 bits of md5(seed|key)."""
    hexed = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("bigint") / F.lit(float(1 << 60))


def fold_of(key: Column, folds: int, seed: int = 6161) -> Column:
    return F.least(F.floor(hash_unit(key, seed) * folds), F.lit(folds - 1)).cast("int")
