"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import ship


def session(app: str = "cytofold", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """AQE, Arrow and UTC on; conf: further settings."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in (conf or {}).items():
        b = b.config(key, value)
    spark = (b.master(master) if master else b).getOrCreate()
    ship(spark)
    return spark
