"""A session with the settings this engine is tuned for; callers may bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """Adaptive execution does the sizing: small partitions are joined, skewed ones split."""
    builder = SparkSession.builder.appName("kontra")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(2 * cores),
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
