"""A session with the settings the library expects; on a cluster the launcher's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "kinweave", **settings: str) -> SparkSession:
    """Adaptive execution with skew handling, ANSI arithmetic and UTC; further settings by name (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
