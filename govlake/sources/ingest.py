"""Manifest-driven export and transfer: pending tables, retries, failure classes, reconciliation."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.sources.catalog import list_files

#: Failure classes and the words that show them (fixed values); the rest may be tried again.
CLASSES = (
    ("INCOMPATIBLE", "not supported|unsupported type|geography|json type"),
    ("ACCESS_DENIED", "access denied|permission denied|not authorized|403|does not exist|not found"),
)


def classify(message: Column) -> Column:
    out = None
    for name, words in CLASSES:
        hit = F.lower(message).rlike(words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("RETRY")


def classify_text(message: str) -> str:
    import re

    return next((name for name, words in CLASSES if re.search(words, message.lower())), "RETRY")


def pending(wanted: DataFrame, done: DataFrame, key: str = "table") -> DataFrame:
    """Tables that the manifest does not list as done."""
    return wanted.join(done.select(key), key, "left_anti")


def reconcile(source: DataFrame, target: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Keys whose counts differ between two inventories."""
    a, b = source.select(*keys, F.col(count).alias("source_n")), target.select(*keys, F.col(count).alias("target_n"))
    return a.join(b, keys, "full_outer").filter(F.coalesce("source_n", F.lit(0)) != F.coalesce("target_n", F.lit(0)))


def export_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _export(spark: SparkSession, name: str, read: Callable[[], DataFrame], path: str, partition_by: list[str] | None, attempts: int, pause: float) -> str:
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)  # of this thread: tables share the cluster fairly
    for attempt in range(1, attempts + 1):
        try:
            export_table(read(), path, partition_by)
            return "DONE"
        except Exception as error:  # every kind is reported by class
            found = classify_text(str(error))
            if found != "RETRY" or attempt == attempts:
                return found
            time.sleep(pause * attempt)
    return "RETRY"


def export_all(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], root: str, done: set[str], attempts: int = 3, pause: float = 10.0, at_once: int = 8, partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Export what is not in ``done``, ``at_once`` tables side by side; name -> DONE or the class of its last failure."""
    names = sorted(set(tables) - done)
    with ThreadPoolExecutor(at_once) as pool:
        ends = pool.map(lambda n: _export(spark, n, tables[n], f"{root}/{n.replace('.', '/')}", (partition_by or {}).get(n), attempts, pause), names)
        return dict(zip(names, ends, strict=True))


def finished(spark: SparkSession, path: str) -> bool:
    """Has a write to ``path`` ended well?"""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def transfer_all(spark: SparkSession, source: str, target: str, at_once: int = 32, attempts: int = 3, pause: float = 10.0) -> dict[str, str]:
    """Copy the tables ``source/dataset/table`` to another store, side by side and with their partitions; those that the target has whole are left."""
    files = list_files(spark, source)
    inside = F.regexp_extract("path", r"/((?:[^/=]+=[^/]*/)*)[^/]*$", 1)
    found = files.groupBy("dataset", "table_name").agg(F.max(inside).alias("inside")).collect()  # a row per table
    tables, keys = {}, {}
    for r in found:
        name, place = f"{r.dataset}.{r.table_name}", f"{source.rstrip('/')}/{r.dataset}/{r.table_name}"
        tables[name] = lambda place=place: spark.read.option("mergeSchema", True).parquet(place)
        keys[name] = [p.split("=", 1)[0] for p in r.inside.split("/") if p]
    done = {n for n in tables if finished(spark, f"{target}/{n.replace('.', '/')}")}
    return {n: "DONE" for n in done} | export_all(spark, tables, target, done, attempts, pause, at_once, keys)
