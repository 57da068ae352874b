"""Semantic layer: join-key graph, table selection by similarity, schema text for prompts."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.functions.scalars import cosine, type_abbrev


class Embedder(Protocol):
    def embed(self, text: str) -> Sequence[float]: ...


@dataclass
class HashingEmbedder:
    """A deterministic embedder without a model: hashed words, normalised."""

    size: int = 64

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.size
        for word in text.lower().split():
            out[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % self.size] += 1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out


@dataclass
class CommandEmbedder:
    """A command that gets the text as its standard input and prints a JSON list of numbers: a real model in its own process."""

    command: list[str]
    patience: float = 300

    def embed(self, text: str) -> list[float]:
        done = subprocess.run(self.command, input=text, capture_output=True, text=True, timeout=self.patience, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} failed: {done.stderr.strip()}")
        return [float(x) for x in json.loads(done.stdout)]


def cosine_select(index: DataFrame, vector: Sequence[float], threshold: float = 0.35, top_k: int | None = None) -> DataFrame:
    """id and similarity of the entries at or above ``threshold``, best first; the question is a literal, not a join."""
    question = F.array(*[F.lit(float(x)) for x in vector])
    scored = index.withColumn("similarity", cosine("embedding", question)).filter(F.col("similarity") >= threshold)
    ordered = scored.orderBy(F.col("similarity").desc(), F.col("id").asc())
    return ordered.limit(top_k) if top_k else ordered


def texts_by_id(index: DataFrame, ids: Sequence[str]) -> list[str]:
    """Texts in the order asked for; unknown ids are left out."""
    found = {r.id: r.text for r in index.filter(F.col("id").isin(list(ids))).select("id", "text").collect()}
    return [found[i] for i in ids if i in found]


def join_key_inventory(registry: DataFrame, most: int = 10) -> DataFrame:
    """Columns that several tables carry: number of tables and up to ``most`` of their names."""
    named = registry.select("name", F.concat_ws(".", "dataset", "table_name").alias("t")).distinct()
    found = named.groupBy("name").agg(F.count(F.lit(1)).cast("long").alias("n_tables"), F.sort_array(F.collect_list("t")).alias("_t"))
    return found.filter("n_tables > 1").select("name", "n_tables", F.array_join(F.slice("_t", 1, most), ", ").alias("sample_tables"))


def join_hints(registry: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """Pairs of tables and the key columns they share."""
    named = registry.select(F.concat_ws(".", "dataset", "table_name").alias("t"), "name").distinct()
    if tables is not None:
        named = named.filter(F.col("t").isin(list(tables)))
    a, b = named.select(F.col("t").alias("a"), "name"), named.select(F.col("t").alias("b"), "name")
    return a.join(b, "name").filter("a < b").groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("keys"))


LEGEND = "V=string I=integer D=double Dt=date B=boolean Dec=decimal Ts=timestamp Ti=time"


def schema_lines(registry: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """table_id and its line ``dataset.table: column:T description ...``."""
    reg = registry.withColumn("table_id", F.concat_ws(".", "dataset", "table_name"))
    if tables is not None:
        reg = reg.filter(F.col("table_id").isin(list(tables)))
    shown = F.concat(F.col("name"), F.lit(":"), type_abbrev("type"), F.coalesce(F.concat(F.lit(" "), F.col("description")), F.lit("")))
    columns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", shown.alias("shown")))), lambda c: c["shown"]), " ")
    return reg.groupBy("table_id").agg(columns.alias("columns")).select("table_id", F.concat("table_id", F.lit(": "), "columns").alias("line"))


def schema_prompt(registry: DataFrame, tables: Sequence[str] | None = None) -> str:
    """Prompt text: header, legend and a line per table."""
    lines = [r.line for r in schema_lines(registry, tables).orderBy("table_id").collect()]
    return "\n".join(["# schema", f"# {LEGEND}", *lines])


def table_names(compact: str) -> list[str]:
    """Names before the colon in lines that are no comments."""
    return [line.split(":", 1)[0].strip() for line in compact.splitlines() if ":" in line and not line.startswith("#")]


def registry_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(F.countDistinct("dataset").cast("long").alias("datasets"), F.countDistinct("dataset", "table_name").cast("long").alias("tables"))


#: Business objects and their links, as two small tables.
OBJECTS = (("company", "cnpj_basico"), ("establishment", "cnpj"), ("person", "cpf"), ("municipality", "id_municipio"), ("contract", "id_contrato"), ("auction", "id_licitacao"), ("candidate", "titulo_eleitoral"), ("agency", "id_orgao"))
LINKS = (("company", "establishment", "1:N"), ("company", "person", "N:M"), ("municipality", "establishment", "1:N"), ("agency", "contract", "1:N"), ("auction", "contract", "1:N"), ("establishment", "auction", "N:M"), ("candidate", "company", "N:M"), ("person", "candidate", "1:N"))


def ontology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(OBJECTS, "object string, key string"), spark.createDataFrame(LINKS, "source string, target string, kind string")
