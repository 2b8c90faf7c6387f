"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def line_key(line: Column) -> Column:
    """The normalised form under which lines are compared."""
    return lower_ascii(F.btrim(line, F.lit(WS)))


def digest(c: Column) -> Column:
    """128 bits of a string: wide enough for corpus-sized sets of distinct lines."""
    return F.unhex(F.md5(c))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_CLASS + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="weftlink-")
    return own


def materialise(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when an executor is lost; a folder per ``by``.

    The shuffle files that the write needed go as it ends, so a chain of tables holds one step's files at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to a dict of columns (None: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(it):
        import pyarrow as pa

        for batch in it:
            if batch.num_rows and (out := fn(batch)) is not None:
                columns = [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)
