"""Sources and sinks: TSV records, id lists, cached Parquet tables, submission files and their checks."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "entity_id")])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns {lacking} are missing from {df.columns}")
    return df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text, all strings: doubled quotes are decoded, "NA" is a value, nothing is null."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="\x00", emptyValue="", enforceSchema=False)
    return df.na.fill("").select(*(columns or schema.names))


def check_source(df: DataFrame, source: int) -> DataFrame:
    """Raises unless ids are unique and carry the source's prefix."""
    require_columns(df, *RECORD.names)
    ids = df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    bad = ids.agg(F.count_if(~F.col("entity_id").startswith(f"S{source}-")).alias("prefix"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if bad["prefix"] or bad["repeated"]:
        raise ValueError(f"source {source}: {bad['prefix']} ids without the prefix, {bad['repeated']} repeated ids")
    return df


def _absent(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def _mark(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The mark and configuration of a whole table; a table without them was never finished."""
    try:
        row = spark.read.schema("mark string, config string").json(path.rstrip("/") + ".key").first()
    except Exception as e:
        if not _absent(e):
            raise
        return None
    return row and tuple(row)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: Mapping | None = None, by: str | None = None) -> DataFrame:
    """The Parquet table at ``path``, built once, in folders of column ``by``. A table of another ``key`` is refused.

    The key is written behind the whole table: what a run that died has left has none, and is built again. Put marks of
    the inputs (``fingerprint``) in the key where they can change.
    """
    config = json.dumps(key or {}, sort_keys=True, default=str)
    mark = hashlib.sha256(config.encode()).hexdigest()[:16]
    seen = _mark(spark, path)
    if seen is None:
        build().write.mode("overwrite").parquet(path, partitionBy=by)
        spark.createDataFrame([(mark, config)], "mark string, config string").coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".key")
    elif seen[0] != mark:
        raise ValueError(f"{path} was written under another configuration: {seen[1]}")
    return spark.read.parquet(path)


class Store:
    """The tables of a run's stages, by name. With a folder they stay, and a run that died goes on behind its last whole table;
    a folder that another configuration has filled is refused. Without one they go to the shared folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, key: Mapping | None = None):
        self.spark, self.folder, self.key = spark, folder and folder.rstrip("/"), dict(key or {})

    def __call__(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        if self.folder is None:
            return stage_table(build(), name)
        return cached(self.spark, f"{self.folder}/{name}", build, self.key, by)

    def under(self, name: str) -> Store:
        return Store(self.spark, self.folder and f"{self.folder}/{name}", self.key)


#: Where a dataset's folders may lie under its root.
LAYOUTS = ("", "dataset")


def find_dataset(spark: SparkSession, root: str) -> str:
    """The first layout under ``root`` that has a ``train`` folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for layout in LAYOUTS:
        found = f"{root.rstrip('/')}/{layout}".rstrip("/")
        path = jvm.org.apache.hadoop.fs.Path(f"{found}/train")
        if path.getFileSystem(conf).exists(path):
            return found
    raise ValueError(f"no train folder under {root}, in any of the layouts {LAYOUTS}")


def source_path(folder: str, split: str, source: int) -> str:
    """The file of a source: splits are train and test, sources 1 to 3."""
    if split not in ("train", "test") or source not in (1, 2, 3):
        raise ValueError(f"no source {source} in split {split!r}")
    return f"{folder.rstrip('/')}/{split}/source{source}.tsv"


def load_sources(spark: SparkSession, folder: str, split: str, sources: Sequence[int] = (1, 2, 3), columns: Sequence[str] | None = None, store: Store | None = None) -> DataFrame:
    """The records of some sources, checked, with the columns asked for; from ``store`` where one is given."""

    def one(k: int) -> DataFrame:
        build = lambda: check_source(read_tsv(spark, source_path(folder, split, k)), k)
        return build() if store is None else store(f"{split}-{k}", build)

    rows = reduce(DataFrame.unionByName, map(one, sources))
    return rows.select(*columns) if columns else rows


def load_normalised(records: DataFrame, columns: Sequence[str] | None = None, countries: Sequence[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Normalised records of some countries and of some ids (``entity_id``), with the columns asked for.

    All three reach the scan: a table in folders by country reads only those asked for.
    """
    rows = records if countries is None else records.where(F.col("country").isin(*countries))
    rows = rows if ids is None else rows.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return rows.select(*columns) if columns else rows


def shared_folder(spark: SparkSession) -> str:
    """Where tables between stages go: the cluster's shared folder; a temporary one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = shared_folder.own = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="weftlink-")
    return found


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a stage's rows once, without the plan that made them.

    The shuffle files that the write needed go as it ends, so a chain of stages holds one stage's files at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def parse_id_list(field: Column) -> Column:
    """``"a, b,"`` as an array: trimmed, without empty items, order and repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """``id, ids`` of each line behind the header; a line of more than two fields raises, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.translate("value", "﻿", "").alias("value"))
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) > 2, F.raise_error(F.concat(F.lit("more than two fields: "), F.col("value"))).cast("array<string>")).otherwise(parts)
    rows = lines.select(checked.alias("p")).select(F.trim(F.col("p")[0]).alias("id"), parse_id_list(F.get("p", 1)).alias("ids"))
    return rows.where(~F.col("id").endswith("entity_id"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """One row per true pair; entities without matches have none."""
    return truth.select("source1_entity_id", F.explode(parse_id_list(F.col("matched_entity_ids"))).alias("entity_id"))


def id_lists(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """``source1_entity_id, ids`` for every entity of ``s1``: distinct pool ids in order of ``ord`` (or id), empty if none."""
    order = F.col("ord") if "ord" in pairs.columns else F.col("entity_id")
    firsts = pairs.groupBy("source1_entity_id", "entity_id").agg(F.min(order).alias("o"))
    lists = firsts.groupBy("source1_entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "entity_id"))), lambda x: x["entity_id"]).alias("ids"))
    return s1.select("source1_entity_id").join(lists, "source1_entity_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def check_pairs(pairs: DataFrame, what: str) -> DataFrame:
    require_columns(pairs, *PAIR.names)
    bad = pairs.where(F.col("source1_entity_id").isNull() | F.col("entity_id").isNull() | ~F.col("entity_id").rlike("^S[23]-")).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0]} is no pair of an entity and a pool record")
    return pairs


def write_submission(matches: DataFrame, candidates: DataFrame, s1: DataFrame, out_dir: str) -> None:
    """Two TSV tables, a row per entity in the order of ``position`` where ``s1`` has one (else of ids)."""
    order = "position" if "position" in s1.columns else "source1_entity_id"
    for pairs, column, name in ((matches, "matched_entity_ids", "matches"), (candidates, "candidate_entity_ids", "candidates")):
        lists = id_lists(check_pairs(pairs, name), s1)
        rows = s1.select("source1_entity_id", order).distinct() if order == "position" else s1.select("source1_entity_id")
        out = rows.join(lists, "source1_entity_id").orderBy(order).select("source1_entity_id", F.array_join("ids", ",").alias(column))
        out.write.mode("overwrite").csv(f"{out_dir}/{name}", sep="\t", header=True, emptyValue="")


def validate(matches: DataFrame, candidates: DataFrame, s1: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """``rule, problems``: how many entities or ids break each rule of a submission (the last is a warning only).

    Inputs are id lists (``source1_entity_id, ids``); ``s1`` and ``pool`` hold the valid ids.
    """
    def side(lists, name):
        rows = lists.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"))
        flat = lists.select("source1_entity_id", F.explode("ids").alias("entity_id"))
        known = s1.select("source1_entity_id")
        found = [
            (rows.where("n > 1"), "repeated entity"),
            (known.join(rows, "source1_entity_id", "left_anti"), "missing entity"),
            (rows.join(known, "source1_entity_id", "left_anti"), "unknown entity"),
            (lists.where(F.size(F.array_distinct("ids")) < F.size("ids")), "repeated id"),
            (flat.where(~F.col("entity_id").rlike("^S[23]-")), "foreign id"),
        ]
        if pool is not None:
            found.append((flat.join(pool.select("entity_id"), "entity_id", "left_anti"), "unknown id"))
        return [df.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(f"{name}: {rule}").alias("rule"), "problems") for df, rule in found]

    both = matches.select("source1_entity_id", "ids").join(candidates.select("source1_entity_id", F.col("ids").alias("c")), "source1_entity_id")
    outside = both.where(F.size(F.array_except("ids", "c")) > 0).agg(F.count(F.lit(1)).alias("problems")).select(F.lit("match outside candidates").alias("rule"), "problems")
    parts = [*side(matches, "matches"), *side(candidates, "candidates"), outside]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """``n, key``: an order-free mark of a set of ids."""
    return ids.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(column)).alias("key"))


def file_digest(path: str) -> str:
    """SHA-256 of a local file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def same_files(pairs: Mapping[str, str]) -> dict[str, bool]:
    """Whether each file has the content of the one it is compared with."""
    return {a: file_digest(a) == file_digest(b) for a, b in pairs.items()}
