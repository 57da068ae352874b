"""The queries of the text operators, each over its whole tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.chat import conversation_events, format_chats, masked_text, parse_turns

    nasty = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), role.alias("role"), nasty.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(conversation_events(rows.unionByName(planted)))
    turns = F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select("conv_id", "formatted", turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.decontaminate import contamination

    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.warc import read_records, write_archive

    return read_records(write_archive(table(spark, sf_dir, "pages")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.token_store import read_documents, write_store

    return read_documents(write_store(table(spark, sf_dir, "documents"), token_file(), end_id=0))


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.suffix_family import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from govlake.llm.quality_rules import BASE, quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_format_chats": op1_format_chats,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mix_sources": op3_mix_sources,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc_archive": op5_warc_archive,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_store": op8_token_store,
    "op9_remove_repeats": op9_remove_repeats,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
