"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", name: str = "kindred", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; extra settings as keyword arguments with dots as ``__``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
