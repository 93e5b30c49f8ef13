"""Detection counts kept up to date while contrast files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kontra.operators.detect import deg_counts

SCHEMA = "entity bigint, condition string, effect double, mean_level double, stat double, p_value double, fdr double"


def source(spark: SparkSession, path: str) -> DataFrame:
    """Contrast rows from Parquet files as they appear below a path."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def counts(stream: DataFrame, name: str, checkpoint: str, threshold: float = 0.05) -> StreamingQuery:
    """Run what has arrived through the batch operator; state is one count per condition."""
    out = deg_counts(stream, threshold).writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
