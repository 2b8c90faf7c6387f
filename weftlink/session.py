"""The session settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "weftlink", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and Arrow on; ``conf`` overrides (dots as underscores)."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
