"""Session settings that the panel's plans profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Windows cost far more for each byte than scans, so that small shuffles aren't merged into few tasks.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
