"""Quality rules with cross-document line frequency per host, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, digest, line_key, materialise, words_of


def _repeat_words(words: Column) -> Column:
    """How many words lie in 5-word windows that occur twice or more.

    Windows are compared by the 64-bit hash of their words' hashes. Only texts in which a window repeats are sorted.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(1), F.size(words) - 4)
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.element_at("_h", i + k) for k in range(5)]).alias("h"), i.alias("i")))
    return hashes, windows


def _base(rows: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    hashes, windows = _repeat_words(F.col("_w"))
    rows = rows.withColumn("_w", words_of(F.col("text"))).withColumn("_lines", lines)
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", hashes)
    rows = rows.withColumn(
        "word_chars", F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    ).withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    rows = rows.withColumn("_win", F.when(F.col("n_words") >= 5, windows).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>")))
    repeats = F.size(F.array_distinct(F.transform("_win", lambda x: x["h"]))) < F.size("_win")
    rows = rows.withColumn("_s", F.when(repeats, F.array_sort("_win")))
    twice = F.filter(
        F.sequence(F.lit(1), F.size("_s")),
        lambda k: (F.get("_s", k - 2)["h"].eqNullSafe(F.get("_s", k - 1)["h"])) | (F.get("_s", k)["h"].eqNullSafe(F.get("_s", k - 1)["h"])),
    )
    rows = rows.withColumn("_p", F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(twice, lambda k: F.get("_s", k - 1)["i"]))))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n"), (p + 5).alias("end")),
    )["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_docs: int = 10,
    max_share: float = 0.01,
    min_left_share: float = 0.3,
) -> DataFrame:
    """Base figures of every text, lines above the host's limits, and the verdict; one row per input row.

    A line is normalised (ends stripped, A-Z lower-cased), hashed to 128 bits and counted once per document of its host.
    A line of any length that has a word is above the limits if more than ``max_docs`` documents of the host and more than
    ``max_share`` of them hold it; such lines are the host's furniture. A document is depleted if, without them, it has
    under ``min_words`` words or under ``min_left_share`` of its words. ``kept`` is false if a base rule fails or if the
    document is depleted. ``boilerplate`` lists the digests of the lines to remove. ``host`` and ``text_hash`` (XXH64 of the
    text) come along, so that a caller can tell rows of one id apart.

    Null texts have no words and fail. A null host is a host of its own. Rows that share an id count as one document of a
    host; a null id counts as one document. An empty table gives an empty result. Other columns are not read.

    The text is read once: a table of figures and line digests in the shared folder feeds the counting and the verdict.
    Counts are pre-aggregated, so a host or line with a third of all rows sends one row per task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _base(rows.withColumn("text_hash", F.xxhash64("text")))
    n_line_words = lambda x: F.size(words_of(x))
    lines = F.transform("_lines", lambda x: F.struct(digest(line_key(x)).alias("h"), n_line_words(x).alias("n")))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "text_hash", *figures, lines.alias("lines")), "quality")

    doc = F.struct("doc_id")
    sizes = rows.groupBy(F.col("host").alias("s_host")).agg(F.count_distinct(doc).alias("host_docs"))
    each = rows.select("row", "doc_id", "host", F.explode("lines").alias("x")).select("row", "doc_id", "host", "x.h", "x.n")
    held = each.groupBy("host", "h", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("one").alias("docs")).where(F.col("docs") > max_docs)
    above = held.join(sizes, F.col("host").eqNullSafe(F.col("s_host"))).where(F.col("docs") > max_share * F.col("host_docs"))
    above = above.select(F.col("host").alias("a_host"), F.col("h").alias("a_h"))
    gone = each.join(above, (F.col("h") == F.col("a_h")) & F.col("host").eqNullSafe(F.col("a_host")))
    gone = gone.groupBy("row").agg(F.sum("n").alias("n_line_words"), F.collect_set("h").alias("boilerplate"))
    out = rows.drop("lines").join(gone, "row", "left")
    left = F.col("n_words") - F.coalesce(F.col("n_line_words"), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (left < min_words) | (left < min_left_share * F.col("n_words"))
    return out.select(
        "doc_id",
        "host",
        "text_hash",
        *figures,
        failed.alias("base_failed"),
        F.coalesce(F.col("n_line_words"), F.lit(0)).cast("long").alias("n_line_words"),
        depleted.alias("depleted"),
        (~failed & ~depleted).alias("kept"),
        F.coalesce("boilerplate", F.expr("array()").cast("array<binary>")).alias("boilerplate"),
    )


def without_boilerplate(text: Column, boilerplate: Column) -> Column:
    """``text`` less the lines whose digest is listed."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(boilerplate, digest(line_key(x))))
    return F.when(F.size(boilerplate) == 0, text).otherwise(F.concat_ws("\n", kept))
