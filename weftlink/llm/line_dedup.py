"""Line dedup: lines found in many documents stay in one of them only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, line_key, materialise


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """Explode normalised lines, hash them, count distinct documents per hash, drop and reassemble by position.

    Returns one row per input row: ``doc_id, text_hash, n_lines, n_dropped, text`` (the text that stays) and, as
    one struct ``carried``, the input's columns named in ``carry``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all its lines except those
    in the largest id that holds it. Null and empty texts are one empty line. Rows that share an id count as one document
    and each is cut on its own; a null id is a document too, smaller than any other. An empty table gives an empty result.
    Other columns are not read, so their names do not matter.

    The text crosses one exchange, with the positions to drop; counting moves 16-byte digests, written once as a table in
    the shared folder. A line held by a large
    share of all documents is pre-aggregated before its exchange, and the join that finds its positions is one that
    adaptive execution splits.
    """
    carried = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "text_hash", "pos", digest(F.col("key")).alias("h"))
    lines = materialise(lines, "lines")
    common = lines.groupBy("h", "doc_id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # A table of its own, so that the join below deals out both sides itself and a hot line can be split.
    common = materialise(common.select("h", "keeper"), "common")
    gone = lines.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")).withColumnsRenamed({"doc_id": "g_id", "text_hash": "g_hash"})
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left")
    carried = ["carried"] if carry else []
    out = out.select("doc_id", "text_hash", "text", "gone", F.split("text", "\n").alias("lines"), *carried)
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.transform("gone", lambda p: p + 1))
    kept = F.concat_ws("\n", F.transform(stay, lambda p: F.element_at("lines", p)))
    return out.select(
        "doc_id",
        "text_hash",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        *carried,
    )
