"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, materialise

#: Kinds in the order in which spans at one place are listed: pattern, the group that is the secret, its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "owned": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")


#: A match before its place is known: kind, code points since the match before it, its length, digest of the secret (null: no span).
MATCH = "array<struct<kind:int,gap:int,len:int,h:binary>>"


def _matches(kind: str) -> Column:
    """The kind's matches in the text, in order; the pieces between matches give the gaps."""
    pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    fits = lambda v: F.length(v) >= least
    if kind == "owned":
        fits = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    found = F.transform(
        F.arrays_zip(F.split("text", pattern).alias("gap"), whole.alias("m"), secret.alias("v")),
        lambda x: F.struct(F.lit(list(KINDS).index(kind)).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), F.when(fits(x["v"]), digest(x["v"])).alias("h")),
    )
    # One piece more than matches: the one behind the last.
    return F.when(F.col("text").rlike(pattern), F.slice(found, 1, F.size(found) - 1)).otherwise(F.expr("array()").cast(MATCH)).cast(MATCH)


def _placed(rows: DataFrame) -> DataFrame:
    """``row, doc_id, owner, kind, start, end, h``: one row per span; further tokens only where they overlap no base span.

    Places are running sums of gaps and lengths. Of the base spans that start no later than a token, the one that ends last
    must end before it; of those that start later, the first must start behind it: two running figures, one from each side.
    """
    each = rows.select("row", "doc_id", "owner", F.posexplode("matches").alias("pos", "x")).select("row", "doc_id", "owner", "pos", "x.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("len")).where("h IS NOT NULL")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    base = F.col("kind") < len(BASE)
    each = each.withColumn("last_end", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next_start", F.min(F.when(base, F.col("start"))).over(behind))
    overlaps = (F.coalesce("last_end", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("next_start") < F.col("end"), F.lit(False)))
    return each.where(base | ~overlaps).select("row", "doc_id", "owner", "kind", "start", "end", "h")


def span_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, max_repos: int = 10) -> DataFrame:
    """Spans of secrets, each judged by how many owners and repositories hold its value; one row per input row.

    Base kinds are ``assign``, ``access`` and ``hex``. The method hashes the secret of each span, and of each further token
    of 20 or more key characters with both a letter and a digit that overlaps no base span, and counts over the whole corpus the
    distinct owners (``owner_col``) and repositories (documents) of each hash. A value of at most ``max_owners`` owners and
    ``max_repos`` repositories is owner-specific and looks live; a wider spread marks a copied example. Live further tokens
    are added as kind ``owned``; base spans always stay. ``n_live`` and ``n_example`` count all spans by verdict.

    Null texts are empty. Null owners count as one owner, null ids as one repository; rows that share an id are one
    repository. An empty table gives an empty result. Other columns are not read.

    The text is read once, into a table of matches in the shared folder; places and overlaps are running figures over the
    exploded matches, so a text costs no more than sorting them. A value held by many rows is pre-aggregated, and the
    join that judges its rows is one that adaptive execution can split.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", F.concat(*[_matches(k) for k in KINDS]).alias("matches"))
    rows = materialise(rows, "secrets")
    spans = materialise(_placed(rows), "spans")

    held = spans.groupBy("h", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("h", "owner").agg(F.count("one").alias("n"))
    spread = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    repos = held.groupBy("h", "doc_id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("repos"))
    spread = spread.join(repos, "h").where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select(F.col("h").alias("l_h"))
    judged = spans.join(materialise(spread, "live"), F.col("h") == F.col("l_h"), "left").withColumn("live", F.col("l_h").isNotNull())
    base, live, place = F.col("kind") < len(BASE), F.col("live"), F.struct("start", "kind", "end")
    judged = judged.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{BASE[k]}") for k in range(len(BASE))],
        F.sort_array(F.collect_list(F.when(base, place))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | live, place))).alias("all"),
        F.count_if(~base & live).alias("n_owned"),
        F.count_if(live).alias("n_live"),
        F.count_if(base & ~live).alias("n_example"),
    )
    out = rows.select("row", "doc_id").join(judged, "row", "left")
    figure = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>")
    return out.select(
        "doc_id",
        *[figure(f"n_{k}") for k in BASE],
        span_text(F.coalesce("base", none)).alias("base_spans"),
        span_text(F.coalesce("all", none)).alias("spans"),
        figure("n_owned"),
        figure("n_live"),
        figure("n_example"),
    )
