"""Records that arrive in a stream, against a pool at rest: candidates by exact keys, within Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import L, R


def capped_keys(pool: DataFrame, keys: Sequence[str], max_group: int) -> DataFrame:
    """Pool records whose key is not empty and is held by at most ``max_group`` of them: the static side of a stream join."""
    some = pool.where(F.col(keys[-1]) != "").select(F.col("entity_id").alias(R), *keys)
    small = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_group).drop("_n")
    return some.join(small, list(keys))


def stream_candidates(arrivals: DataFrame, pool: DataFrame, keys: Sequence[str] = ("country", "name_core"), max_group: int = 20) -> DataFrame:
    """Pairs of arriving entities and pool records, each in the micro-batch that the entity comes in; append mode, no state."""
    return arrivals.select(F.col("entity_id").alias(L), *keys).join(capped_keys(pool, keys, max_group), list(keys)).select(L, R)
