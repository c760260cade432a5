"""Session settings that suit the plans of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SETTINGS = {
    # The JVM does not compile methods above 8000 bytes of bytecode, and cleaning or rule projections get
    # there. Below the limit Spark cuts such projections into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Sizes are not known before a job runs: join strategy, skew and partition counts are decided then.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Folders that one listing task goes through: by default each has a task of its own, up to 10 000.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark
