"""Session factory with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "stratakv", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and parquet page checksums that are verified on read.

    Checksum verification is off by default in Spark; without it a flipped byte makes a key
    vanish instead of raising an error.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.hadoop.parquet.page.verify-checksum.enabled": "true",
        "spark.hadoop.parquet.page.write-checksum.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
