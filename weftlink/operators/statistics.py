"""Statistics of the pool that features read: frequencies, document frequencies and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def doc_freq(df: DataFrame, column: str) -> DataFrame:
    """``country, token, df``: records that hold each word."""
    return df.select("country", F.explode(F.array_distinct(T.words(F.col(column)))).alias("token")).groupBy("country", "token").agg(F.count(F.lit(1)).alias("df"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``country, value, n``: records with each non-empty value."""
    return df.where(F.col(column) != "").groupBy("country", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(F.count(F.lit(1)).alias("n_docs"))


def per_million(df: DataFrame, other: DataFrame, key: str, name: str, same: bool) -> DataFrame:
    """``df`` with the records of ``other`` per million that share its ``key``; its own record is left out of its own side."""
    counts, total = value_counts(other, key), totals(other)
    out = df.join(counts.select("country", F.col("value").alias(key), F.col("n").alias("_n")), ["country", key], "left").join(total, "country", "left")
    n, of = F.coalesce("_n", F.lit(0)), F.coalesce("n_docs", F.lit(0))
    if same:
        n, of = F.greatest(n - 1, F.lit(0)), of - 1
    rate = F.when(F.col(key) != "", n / F.greatest(of, F.lit(1)) * 1e6)
    return out.withColumn(name, rate.cast("float")).drop("_n", "n_docs")


def add_frequencies(s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the rates of their name on their own side, on the other, and of its first word on the other."""
    out = []
    for own, other in ((s1, pool), (pool, s1)):
        df = per_million(own, own, "name_core", "freq_same", True)
        df = per_million(df, other, "name_core", "freq_other", False)
        out.append(per_million(df, other, "name_first", "freq_first_other", False))
    return out[0], out[1]


def idf_table(pool: DataFrame, column: str = "name_core") -> DataFrame:
    """``token, idf`` as ln(N / df), over all countries."""
    n = pool.agg(F.count(F.lit(1))).scalar()
    df = pool.select(F.explode(F.array_distinct(T.words(F.col(column)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", F.log(n / F.col("df")).alias("idf"))


def smooth_idf(pool: DataFrame, column: str) -> DataFrame:
    """``country, token, idf`` as ln((1 + N) / (1 + df)) + 1, with the country's N."""
    return doc_freq(pool, column).join(totals(pool), "country").select("country", "token", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "n_docs")


def in_degree(pairs: DataFrame) -> DataFrame:
    """``entity_id, n``: entities that each pool record is a candidate of."""
    return pairs.groupBy("entity_id").agg(F.count_distinct("source1_entity_id").alias("n"))
