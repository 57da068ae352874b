"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality rules, near-duplicates, decontamination, mixing, token ids. All stages but the last return
the columns of ``documents``; the last returns the places and checksums of the token store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from govlake.llm.common import Scratch, release, written
from govlake.llm.decontaminate import remove_contaminated
from govlake.llm.mixing import mix_rows
from govlake.llm.near_duplicates import drop_near_duplicates
from govlake.llm.quality_rules import keep_good
from govlake.llm.queries import token_file
from govlake.llm.token_store import read_documents, write_store

SHINGLE, SIMILAR_PERCENT, CONTAMINATED_PERCENT = 5, 80, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id."""
    return drop_near_duplicates(docs, SHINGLE, SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words is benchmark text go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), CONTAMINATED_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes of each document."""
    return mix_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the token store."""
    return read_documents(write_store(docs, token_file(), end_id=0))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

#: Connected components and byte-pair encoding are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage and its operators have written goes when its rows are written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        before = written()
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{number}")
        release(spark, written() - before)
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs
