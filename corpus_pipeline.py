"""A corpus pipeline of five stages: quality rules, line dedup, near-duplicates, decontamination, tokens.

A stage decides on rows, not on ids: a row is known by its id, its text and, where hosts matter, its host. So a null or
repeated id carries no decision from one text to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import materialise, table
from weftlink.llm.decontaminate import contained_items
from weftlink.llm.line_dedup import line_dedup
from weftlink.llm.pieces import encode_decode, read_model
from weftlink.llm.quality import quality_rules, without_boilerplate
from weftlink.llm.simhash import near_duplicates

#: SQL cannot express the last stage; tests/llm holds the whole against a brute-force version.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _row_key(*more: str) -> Column:
    """What tells rows apart: null ids behind all others, then the id, then the text (null reads as empty), then ``more``."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text.alias("text"), *[F.col(c).alias("row") for c in more])


def _with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the columns of ``docs``: the text from column ``text``, and its length where ``docs`` lists one."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their host's furniture lines.

    Null and empty texts have too few words and go, long ones are judged whole. Rows that share an id are judged each by
    their own text and host, so rows equal in all three stay or go together. Null ids and hosts are values like any other.
    An empty table gives an empty one; further columns pass through under any name.
    """
    key, lines, text = _fresh(docs, "_key"), _fresh(docs, "_lines"), _fresh(docs, "_new_text")
    judged = quality_rules(docs).where("kept").select(F.struct("doc_id", "host", "text_hash").alias("judged"), "boilerplate")
    judged = judged.groupBy("judged").agg(F.first("boilerplate").alias(lines))  # equal rows have equal lines
    own = F.struct(docs["doc_id"].alias("doc_id"), docs["source"].alias("host"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"))
    kept = docs.withColumn(key, own).join(judged, F.col(key) == F.col("judged"))
    return _with_text(docs, kept.withColumn(text, without_boilerplate(F.coalesce(docs["text"], F.lit("")), F.col(lines))), text)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the largest id that holds them.

    No row goes: there is one row per input row, repeated ones included, each cut on its own. Null texts become one empty
    line; a null id counts as one document, smaller than any other. Texts of any length are cut whole. An empty table gives
    an empty one; further columns pass through under any name.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    text = _fresh(docs, "_new_text")
    found = line_dedup(docs, carry=others)
    found = found.select("doc_id", F.col("text").alias(text), *[F.col(f"carried.`{c}`").alias(c) for c in others])
    return _with_text(docs, found, text)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays: the one with the smallest id, null ids behind all others.

    Ties of one id go to the smaller text hash, and of rows equal in id and text the first stays: rows are numbered in a table of
    their own. Null, empty and blank texts are one class, long texts are read whole. An empty table gives an empty one;
    further columns pass through under any name.
    """
    row, key = _fresh(docs, "_row"), _fresh(docs, "_key")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.withColumn(key, _row_key(row)), id_col=key)
    firsts = found.where("doc_id = component_id").select(F.col("doc_id.row").alias("first"))
    return rows.join(firsts, F.col(row) == F.col("first"), "left_semi").drop(row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a test item go, all that are equal in id and text; no other row does.

    Null and empty texts hold no item and stay, long texts are searched whole. Null and repeated ids lose only the rows whose
    own text holds an item. An empty table gives an empty one; further columns pass through under any name.
    """
    key = _fresh(docs, "_key")
    keyed = docs.withColumn(key, _row_key())
    found = contained_items(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias("found")).distinct()
    return keyed.join(found, F.col(key) == F.col("found"), "left_anti").drop(key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row that is left, one per row, repeated rows and null ids included.

    Null and empty texts have no tokens; long texts are encoded whole. An empty table gives an empty one; other columns are
    not read.
    """
    return encode_decode(docs, read_model()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near), ("decontamination", decontaminated), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage reads the table that the one before has left in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
