"""Documents read as records of three sources: the deterministic world that queries, tests and bench share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.blocking import BlockingConfig, TopK, block
from ..operators.features import align, jaccard, sets
from ..operators.match import heuristic
from ..sources.tables import stage_table

L, R = "source1_entity_id", "entity_id"
FILLERS = ("the", "of", "de", "la", "and")
SPACE = TopK("name_addr", k=5, min_sim=0.2, min_df=2, max_df=0.02)
_TABLES: dict[tuple[str, str, str], DataFrame] = {}
BLOCKING = BlockingConfig(max_group=20, max_per_s1=60, spaces=(SPACE,))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records: the first four words are the name, a number and the next eight words the address.

    ``text_key`` is the SHA-256 of the text, which is all that is asked of the rest: the table of records holds no texts.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = docs.select("doc_id", "text", "lang", "n_chars", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    name, rest = F.slice("w", 1, 4), F.slice("w", 5, 8)
    addr = F.trim(F.concat_ws(" ", (F.col("n_chars") % 500).cast("string"), F.array_join(rest, " ")))
    last = F.filter(rest, lambda t: ~t.rlike("^[0-9]+$"))
    out = w.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("entity_id"),
        (1 + F.col("doc_id") % 3).cast("int").alias("source"),
        F.col("lang").alias("country"),
        F.unhex(F.sha2("text", 256)).alias("text_key"),
        F.array_join(name, " ").alias("name_core"),
        addr.alias("addr_norm"),
        F.array_join(F.array_sort(F.array_distinct(name)), " ").alias("name_sorted"),
        F.array_join(name, "").alias("name_squash"),
        T.missing(F.get("w", 0)).alias("name_first"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(T.missing(F.get("w", 3))).alias("legal_form"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.lpad((F.col("n_chars") % 100_000).cast("string"), 5, "0")).alias("postcode"),
        F.col("lang").alias("region"),
        F.array_join(F.slice(last, F.greatest(F.size(last) - 1, F.lit(1)), 2), " ").alias("addr_last"),
        (F.col("doc_id") % 7 == 0).alias("non_latin"),
        (F.col("doc_id") % 11 == 0).alias("addr_non_latin"),
        F.array_join(F.filter(name, lambda t: ~t.isin(*FILLERS)), " ").alias("name_core_nofill"),
    )
    return out.withColumns(
        {
            "name_norm": F.col("name_core"),
            "addr_nums": F.array_join(T.numbers(F.col("addr_norm")), " "),
            "addr_tokens": F.size(T.words(F.col("addr_norm"))),
            "name_addr": F.trim(F.concat_ws(" ", "name_core", "addr_norm")),
        }
    )


@dataclass
class World:
    """The record view of one folder, with the steps that many queries share."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def records(self) -> DataFrame:
        """Normalised records: each pass reads them, so they are a table."""
        return self._kept("records", lambda: records(self.spark, self.sf_dir))

    def _kept(self, name: str, build) -> DataFrame:
        """A table in the shared folder, made once per session and folder of input: it outlives lost executors."""
        key = self.spark.sparkContext.applicationId, self.sf_dir, name
        if key not in _TABLES:
            _TABLES[key] = stage_table(build(), name)
        return _TABLES[key]

    @property
    def s1(self) -> DataFrame:
        return self.records.where("source = 1")

    @property
    def pool(self) -> DataFrame:
        return self.records.where("source <> 1")

    @property
    def ids(self) -> DataFrame:
        return self.s1.select(F.col("entity_id").alias(L))

    @cached_property
    def truth(self) -> DataFrame:
        """Pool records with the text of an entity, owned by the smallest such id; texts meet by their SHA-256, so none is shuffled."""
        own = self.s1.groupBy("text_key").agg(F.min("entity_id").alias(L))
        return self.pool.select(R, "text_key").join(own, "text_key").select(L, R)

    @cached_property
    def pairs(self) -> DataFrame:
        """Candidates: every later step reads them more than once, so they are a table."""
        return self._kept("candidates", lambda: block(self.s1, self.pool, BLOCKING))

    @cached_property
    def aligned(self) -> DataFrame:
        return align(self.pairs, self.s1, self.pool)

    @cached_property
    def scored(self) -> DataFrame:
        """Pairs with a score of plain expressions: the heuristic and the likeness of addresses."""
        like = F.coalesce(jaccard(*sets("addr_norm")), F.lit(0.0))
        rows = self.aligned.withColumn("pass_exact", (F.col("pass").bitwiseAND(7) != 0).cast("int"))
        return rows.withColumn("prob", F.round(0.6 * heuristic() + 0.4 * like, 6)).withColumn("p1", F.col("prob"))
