"""Defaults of a session for these operators."""

from pyspark.sql import SparkSession


def session(name: str = "tidelens", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI arithmetic, and what conf adds."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
