"""Folds and samples by keyed hashes: order-free, and a pool record goes where its owner goes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import fold_of, hash_unit

L, R = "source1_entity_id", "entity_id"
#: Seeds of the draws.
VAL, TUNE, SAMPLE, MOCK, DROP, FOLD, HARDER = 42, 4242, 7, 5151, 5152, 6161, 99


@dataclass
class Fold:
    s1: DataFrame
    pool: DataFrame
    truth: DataFrame


def val_mask(ids: Column, share: float = 0.2, seed: int = VAL) -> Column:
    return hash_unit(ids, seed) < share


def owners(truth: DataFrame) -> DataFrame:
    """``entity_id, owner``: the first entity of each matched pool record."""
    return truth.groupBy(R).agg(F.min(L).alias("owner"))


def pool_mask(pool: DataFrame, truth: DataFrame, share: float, seed: int, name: str = "val") -> DataFrame:
    """``pool`` with the side its owner falls on; unowned records fall by their own hash."""
    own = pool.join(owners(truth), R, "left")
    return own.withColumn(name, val_mask(F.coalesce("owner", R), share, seed)).drop("owner")


def split_fold(fold: Fold, share: float, seed: int) -> tuple[Fold, Fold]:
    """(inside, outside) of a hash share."""
    pool = pool_mask(fold.pool, fold.truth, share, seed, "_in")
    inside, out = val_mask(F.col("entity_id"), share, seed), val_mask(F.col(L), share, seed)
    return (
        Fold(fold.s1.where(inside), pool.where("_in").drop("_in"), fold.truth.where(out)),
        Fold(fold.s1.where(~inside), pool.where("NOT _in").drop("_in"), fold.truth.where(~out)),
    )


def inner_split(train: Fold) -> tuple[Fold, Fold]:
    return split_fold(train, 0.25, TUNE)


def sample_s1(s1: DataFrame, n: int, seed: int = SAMPLE) -> DataFrame:
    """A hash sample of about ``n`` entities; a larger sample holds every smaller one."""
    total = s1.agg(F.count(F.lit(1))).scalar()
    return s1.where(hash_unit(F.col("entity_id"), seed) < F.lit(float(n)) / total)


def pair_sample(pairs: DataFrame, share: float, seed: int = SAMPLE) -> DataFrame:
    return pairs.where(hash_unit(F.concat_ws("|", L, R), seed) < share)


def smallest_hash(rows: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    return rows.withColumn("_h", hash_unit(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def hash_window(rows: DataFrame, key: Column, low: float, high: float, seed: int) -> DataFrame:
    h = hash_unit(key, seed)
    return rows.where((h >= low) & (h < high))


def budget_sample(rows: DataFrame, key: str, size: str, budget: float, seed: int, strata: str) -> DataFrame:
    """Groups in hash order while their running size stays within the budget, per stratum."""
    order = W.partitionBy(strata).orderBy("_h", key).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_h", hash_unit(F.col(key), seed)).withColumn("_run", F.sum(size).over(order)).where(F.col("_run") <= budget).drop("_h", "_run")


def harder_fold(fold: Fold, share: float = 0.2) -> Fold:
    """Without a share of the entities; their pool records stay as decoys."""
    left = fold.s1.where(hash_unit(F.col("entity_id"), HARDER) >= share)
    return Fold(left, fold.pool, fold.truth.join(left.select(F.col("entity_id").alias(L)), L, "left_semi"))


def cv_fold(df: DataFrame, folds: int, key: str = L) -> DataFrame:
    return df.withColumn("fold", fold_of(F.col(key), folds, FOLD))


def shape(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``country, n_s1, n_pool``."""
    a, b = (df.groupBy("country").agg(F.count(F.lit(1)).alias(n)) for df, n in ((s1, "n_s1"), (pool, "n_pool")))
    return a.join(b, "country", "full").na.fill(0)


def mock_fold(fold: Fold, target: Mapping[str, tuple[int, int]], roles: DataFrame, drop_first: DataFrame | None = None) -> tuple[Fold, DataFrame]:
    """A fold of the target's shape per country (``(n_s1, n_pool)``) and a role per entity.

    Entities stay by hash with the target's share of the pool, and their records with them (unowned records by their own
    hash). Then entities of ``drop_first`` leave, and of the role ``fit`` those with the smallest other hash, until the number
    of entities fits the pool that is left. Entities of role val or tune never leave in the last step; a country without a
    target stays whole. ``roles`` is ``entity_id, role``.
    """
    spark = fold.s1.sparkSession
    goal = spark.createDataFrame([(c, *v) for c, v in target.items() if all(v)], "country string, goal_s1 long, goal_pool long")
    have = shape(fold.s1, fold.pool).join(F.broadcast(goal), "country", "left")
    share = have.select(
        "country", F.coalesce(F.least(F.lit(1.0), F.col("goal_pool") / F.col("n_pool")), F.lit(1.0)).alias("share"), (F.col("goal_pool") / F.col("goal_s1")).alias("ratio")
    )
    s1 = fold.s1.join(share, "country").where(hash_unit(F.col("entity_id"), MOCK) < F.col("share"))
    pool = fold.pool.join(owners(fold.truth), R, "left").join(share, "country")
    pool = pool.where(hash_unit(F.coalesce("owner", R), MOCK) < F.col("share")).drop("owner", "share")
    want = pool.groupBy("country", "ratio").agg(F.count(F.lit(1)).alias("kept")).select("country", F.rint(F.col("kept") / F.col("ratio")).cast("long").alias("want"))
    if drop_first is not None:
        s1 = s1.join(drop_first.select("entity_id"), "entity_id", "left_anti")
    rows = s1.join(roles, "entity_id", "left").withColumn("role", F.coalesce("role", F.lit("fit"))).join(want, "country", "left")
    order = W.partitionBy("country").orderBy((F.col("role") != "fit").cast("int"), hash_unit(F.col("entity_id"), DROP), "entity_id")
    extra = F.count(F.lit(1)).over(W.partitionBy("country")) - F.coalesce("want", F.lit(1 << 62))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_extra", extra)
    kept = rows.where((F.col("role") != "fit") | (F.col("_n") > F.col("_extra"))).select(*fold.s1.columns, "role")
    truth = fold.truth.join(kept.select(F.col("entity_id").alias(L)), L, "left_semi")
    return Fold(kept.drop("role"), pool.drop("ratio"), truth.select(L, R)), kept.select("entity_id", "role")
