"""Dictionaries learnt from true pairs: token maps, fillers and evidence of single words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .blocking import existing, one_word_pairs

L, R = "source1_entity_id", "entity_id"


def _texts(truth: DataFrame, s1: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    a = s1.select(F.col("entity_id").alias(L), T.words(F.col(column)).alias("l"))
    return truth.join(a, L).join(pool.withColumn("r", T.words(F.col(column))), R)


def fit_token_map(truth: DataFrame, s1: DataFrame, pool: DataFrame, column: str = "name_norm", flag: str = "non_latin", min_count: int = 3, min_share: float = 0.5) -> DataFrame:
    """``token, partner, n, share``: for words of other scripts, the word that most often stands at their place.

    True pairs with as many words on both sides are aligned by position. Identical words count in a word's total but are no
    partners.
    """
    pairs = _texts(truth, s1, pool, column).where(F.col(flag) & (F.size("l") == F.size("r")))
    rows = pairs.select(F.explode(F.arrays_zip("l", "r")).alias("x")).groupBy(F.col("x.r").alias("token"), F.col("x.l").alias("partner")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("token").agg(F.sum("n").alias("total"))
    best = W.partitionBy("token").orderBy(F.desc("n"), "partner")
    top = rows.where("token <> partner").withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").join(total, "token")
    return top.where((F.col("n") >= min_count) & (F.col("n") >= min_share * F.col("total"))).select("token", "partner", "n", (F.col("n") / F.col("total")).alias("share"))


def fit_fillers(truth: DataFrame, s1: DataFrame, pool: DataFrame, min_share: float = 1e-4, min_ratio: float = 1.0) -> DataFrame:
    """``token, added, held``: words that the pool adds to true pairs at least as often as entities hold them."""
    pairs = _texts(truth, s1, pool, "name_core")
    if "non_latin" in pool.columns:
        pairs = pairs.where(~F.col("non_latin"))
    n = pairs.agg(F.count(F.lit(1))).scalar()
    added = F.transform(F.array_except("r", "l"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("a"), F.lit(0).alias("h")))
    held = F.transform(F.array_distinct("l"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("a"), F.lit(1).alias("h")))
    rows = pairs.select(F.explode(F.concat(added, held)).alias("x")).groupBy(F.col("x.token").alias("token")).agg(F.sum("x.a").alias("added"), F.sum("x.h").alias("held"))
    return rows.where((F.col("added") >= min_share * n) & (F.col("added") > 0) & (F.col("added") >= min_ratio * (F.col("held") + 1)))


def near_duplicates(s1: DataFrame, pool: DataFrame, truth: DataFrame, max_group: int = 20) -> DataFrame:
    """``side, word, match`` of pairs of names that one word tells apart."""
    pairs = existing(one_word_pairs(s1, pool, max_group), truth, "match")
    return pairs.select("side", "word", F.col("match").cast("int").alias("match"))


def log_odds(pairs: DataFrame, min_support: int = 3, k: float = 20.0) -> DataFrame:
    """``side, word, n, llr``: how a word's pairs lean to matches against its side's share, shrunk by ``k`` pairs.

    With m matches of n pairs and a side's share s: ln((m + k s) / S) - ln((n - m + k (1 - s)) / D), S and D being s and
    1 - s. A side without matches or without others has no contrast and no rows.
    """
    base = pairs.groupBy("side").agg(F.avg("match").alias("s")).where("s > 0 AND s < 1")
    rows = pairs.groupBy("side", "word").agg(F.count(F.lit(1)).alias("n"), F.sum("match").alias("m")).where(F.col("n") >= min_support).join(base, "side")
    yes = (F.col("m") + k * F.col("s")) / F.col("s")
    no = (F.col("n") - F.col("m") + k * (1 - F.col("s"))) / (1 - F.col("s"))
    return rows.select("side", "word", "n", F.round(F.log(yes / no), 4).alias("llr"))


def fit_evidence(s1: DataFrame, pool: DataFrame, truth: DataFrame, max_group: int = 20, min_support: int = 3, k: float = 20.0) -> DataFrame:
    return log_odds(near_duplicates(s1, pool, truth, max_group), min_support, k)


def as_map(table: DataFrame, limit: int = 100_000) -> dict[str, str]:
    """A learnt token map as a dictionary; a table of more than ``limit`` words is refused, as maps travel in the plan."""
    rows = table.select("token", "partner").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the token map has more than {limit} words")
    return dict(map(tuple, rows))


def as_list(table: DataFrame, limit: int = 10_000) -> list[str]:
    """Learnt fillers in order; a table of more than ``limit`` words is refused, as they travel in the plan."""
    rows = table.select("token").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"there are more than {limit} fillers")
    return sorted(r["token"] for r in rows)
