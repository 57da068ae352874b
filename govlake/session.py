"""Session builder with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.scheduler.mode": "FAIR",  # statements run side by side; no lock around the session
}


def build_session(app: str = "govlake", master: str | None = None, threads: int | None = None, memory: str | None = None, **settings: str) -> SparkSession:
    """A session; ``settings`` (dots as double underscores) win over the defaults.

    ``threads`` and ``memory`` limit a session on one machine, as for the query service (4 threads, 6g).
    """
    builder = SparkSession.builder.appName(app)
    master = f"local[{threads}]" if threads and not master else master
    if memory:
        settings = {"spark__driver__memory": memory, **settings}
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
