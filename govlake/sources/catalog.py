"""Catalog over Parquet files: listing, views, schema registry, inventory, samples, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlake.functions.scalars import csv_line, human_size

FILES = "dataset string, table_name string, path string, bytes bigint"
#: Keys of field metadata that hold a description, tried in this order (fixed values).
NOTES = ("description", "DESCRIPTION", "comment", "doc")
REGISTRY = "dataset string, table_name string, ordinal int, name string, type string, nullable boolean, description string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """dataset, table_name, path, bytes of the Parquet files ``root/dataset/table/...``; the reader lists them in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path", F.col("length").alias("bytes"))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), f"^{base}/", "")
    parts = F.split(inside, "/")
    return files.withColumn("_p", parts).filter(F.size("_p") >= 3).select(F.get("_p", F.lit(0)).alias("dataset"), F.get("_p", F.lit(1)).alias("table_name"), "path", "bytes")


def inventory(files: DataFrame, largest: str = "TB") -> DataFrame:
    """Files and bytes of each table, each dataset and all (nulls in the totals); sizes in units up to ``largest``."""
    sums = files.rollup("dataset", "table_name").agg(F.count(F.lit(1)).cast("long").alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    return sums.withColumn("size", human_size("bytes", largest))


def cost_estimate(bytes_: DataFrame, column: str = "bytes") -> DataFrame:
    """Gigabytes, the range after compression (a tenth to a fifth) and the range of transfer costs (0.08 to 0.12 a GB)."""
    gb = F.sum(column) / F.lit(1024.0**3)
    return bytes_.agg(F.round(gb, 6).alias("gb"), F.round(gb / 10, 6).alias("least_gb"), F.round(gb / 5, 6).alias("most_gb"), F.round(gb / 10 * 0.08, 8).alias("least_usd"), F.round(gb / 5 * 0.12, 8).alias("most_usd"))


@dataclass
class Catalog:
    """Databases and tables over folders of files; Hive partitions and columns are united by name."""

    spark: SparkSession
    hot: tuple[str, ...] = ()

    def read(self, files: Iterable[str], base: str | None = None) -> DataFrame:
        reader = self.spark.read.option("mergeSchema", True)
        if base:
            reader = reader.option("basePath", base)
        return reader.parquet(*sorted(files))

    def build(self, root: str, at_once: int = 8) -> list[str]:
        """A database per dataset and a read-only table per folder, with the columns of all its files united by name.

        Footers are merged by a job per table, ``at_once`` side by side, and the schema is kept, so
        no query reads footers to learn it. Tables with geometry columns are skipped.
        """
        found = [(r.dataset, r.table_name) for r in list_files(self.spark, root).select("dataset", "table_name").distinct().orderBy("dataset", "table_name").collect()]
        place = lambda name: f"{root.rstrip('/')}/{name[0]}/{name[1]}"
        with ThreadPoolExecutor(at_once) as pool:
            schemas = list(pool.map(lambda name: self.read([place(name)]).schema, found))
        made = []
        for name, schema in zip(found, schemas, strict=True):
            if any(f.name.lower() in ("geometry", "geometria") and isinstance(f.dataType, T.BinaryType) for f in schema):
                continue
            dataset, table = name
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{dataset}`")
            if self.spark.catalog.tableExists(f"`{dataset}`.`{table}`"):
                kind = "VIEW" if self.spark.catalog.getTable(f"`{dataset}`.`{table}`").tableType == "VIEW" else "TABLE"
                self.spark.sql(f"DROP {kind} `{dataset}`.`{table}`")  # the files stay: they are external
            self.spark.catalog.createTable(f"`{dataset}`.`{table}`", path=place(name), source="parquet", schema=schema)
            made.append(f"{dataset}.{table}")
        return made

    def tables(self) -> DataFrame:
        """schema_name and table_name of all views; Spark has no information_schema."""
        rows = [(d.name, t.name) for d in self.spark.catalog.listDatabases() for t in self.spark.catalog.listTables(d.name) if not t.isTemporary]
        return self.spark.createDataFrame(rows, "schema_name string, table_name string")

    def describe(self, sql: str) -> list[str]:
        """Column names of a query, without running it."""
        return self.spark.sql(sql).columns

    def warm(self) -> dict[str, bool]:
        """Touch the hot tables; those that fail are reported, not raised."""
        out = {}
        for name in self.hot:
            try:
                self.spark.table(name).limit(1).collect()
                out[name] = True
            except Exception:  # a missing table must not stop a start
                out[name] = False
        return out

    def materialize(self, view: str, path: str, partition_by: list[str] | None = None) -> None:
        writer = self.spark.table(view).write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _type_name(kind: T.DataType) -> str:
    return kind.simpleString().upper()


def footer_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Key/value metadata in the footer of the first Parquet file at or below ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf).listFiles(place, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().endswith(".parquet"):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
            try:
                return dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
            finally:
                reader.close()
    return {}


def footer_descriptions(metadata: dict[str, str]) -> dict[str, str]:
    """Descriptions of columns that writers leave in a footer as JSON: the ``pandas`` block and embedded schemas with field metadata."""
    out: dict[str, str] = {}
    for key in ("pandas", "pandas_metadata", "org.apache.spark.sql.parquet.row.metadata"):
        try:
            block = json.loads(metadata.get(key, "{}"))
        except ValueError:  # not JSON: nothing to learn
            continue
        for column in [*block.get("columns", []), *block.get("fields", [])]:
            notes = column.get("metadata")
            note = next((notes[k] for k in NOTES if k in notes), None) if isinstance(notes, dict) else None
            if note is not None and column.get("name"):
                out[column["name"]] = str(note)
    return out


def registry(spark: SparkSession, tables: dict[str, str], at_once: int = 8) -> DataFrame:
    """The schema registry of ``dataset.table -> path``, from a footer a table, ``at_once`` side by side."""

    def read(item: tuple[str, str]) -> list[tuple]:
        name, path = item
        dataset, _, table = name.rpartition(".")
        notes = footer_descriptions(footer_metadata(spark, path))
        rows = []
        for i, f in enumerate(spark.read.parquet(path).schema):
            note = next((str(f.metadata[k]) for k in NOTES if k in f.metadata), notes.get(f.name))
            rows.append((dataset, table, i, f.name, _type_name(f.dataType), f.nullable, note))
        return rows

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame([r for rows in pool.map(read, sorted(tables.items())) for r in rows], REGISTRY)


def enrich(reg: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions from a metadata table whose columns are found by name; known ones stay."""
    pick = lambda *words: next((c for c in descriptions.columns if any(w in c.lower() for w in words)), None)
    text, table, column = pick("desc"), pick("table", "tabela"), pick("column", "coluna", "name", "nome")
    dataset = pick("dataset", "schema")
    if not (text and table and column):
        return reg
    keys = [(dataset, "dataset"), (table, "table_name"), (column, "name")]
    side = descriptions.select(*[F.col(a).alias(f"_{b}") for a, b in keys if a], F.col(text).alias("_text"))
    on = None
    for a, b in keys:
        if a:
            same = F.col(b) == F.col(f"_{b}")
            on = same if on is None else on & same
    return reg.join(side, on, "left").withColumn("description", F.coalesce("_text", "description")).select(*reg.columns)


def sample_text(df: DataFrame, n: int = 2) -> str:
    """A ``name:type`` header and ``n`` random rows; null is empty."""
    head = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    rows = df.select(csv_line(*df.columns).alias("line")).orderBy(F.rand()).limit(n).collect()
    return "\n".join([head, *[r.line for r in rows]])


def write_registry_json(reg: DataFrame, path: str) -> None:
    """One JSON object per table with its columns."""
    columns = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "type", "nullable", "description"))), lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["nullable"].alias("nullable"), c["description"].alias("description")))
    reg.groupBy("dataset", "table_name").agg(columns.alias("columns")).write.mode("overwrite").json(path)


def tree_markdown(inv: DataFrame) -> str:
    """An inventory as a Markdown listing with totals (one line per table)."""
    rows = sorted((tuple(r) for r in inv.select("dataset", "table_name", "files", "size").collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] is not None, r[1] or ""))
    lines = []
    for dataset, table, files, size in rows:
        lines.append(f"\n**Total**: {files} files, {size}" if dataset is None else f"\n## {dataset} ({files} files, {size})" if table is None else f"- {table}: {files} files, {size}")
    return "\n".join(lines).strip() + "\n"


def rows_as_json(df: DataFrame) -> DataFrame:
    """A JSON object per row: decimals as numbers, dates as ISO text, nulls kept."""
    cast = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cast), {"ignoreNullFields": "false"}).alias("json"))


def csv_rows(df: DataFrame, separator: str = ",") -> DataFrame:
    """A column ``line``: rows as CSV with fields quoted where they need it; nulls are empty."""
    return df.select(csv_line(*df.columns, separator=separator, quoted=True).alias("line"))


def csv_header(df: DataFrame, separator: str = ",") -> str:
    return separator.join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in (separator, '"', "\n")) else c for c in df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, quotes doubled inside quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


#: Options of the text formats besides their names: everything is read as text but JSON, whose types are its own.
EXTERNAL = {
    "csv": {"header": True, "quote": '"', "escape": '"', "multiLine": True, "inferSchema": False},
    "tsv": {"header": True, "sep": "\t", "inferSchema": False},
    "json": {"multiLine": False},
    "xml": {"rowTag": "row"},
    "parquet": {"mergeSchema": True},
    "orc": {"mergeSchema": True},
    "text": {},
}


def read_external(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table in another format; ``options`` win over those of ``EXTERNAL``."""
    if kind not in EXTERNAL:
        raise ValueError(f"unknown format {kind}; known: {', '.join(sorted(EXTERNAL))}")
    reader = spark.read.format("csv" if kind == "tsv" else kind).options(**{**EXTERNAL[kind], **options})
    return (reader.schema(schema) if schema else reader).load(path)


def box_table(df: DataFrame, most: int = 100) -> str:
    """A text box with at most ``most`` rows."""
    rows = [[("NULL" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
    if not rows:
        return "(no rows)"
    width = [max(len(c), *(len(r[i]) for r in rows)) for i, c in enumerate(df.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([rule, line(df.columns), rule, *map(line, rows), rule, f"({len(rows)} rows)"])


def registry_json(reg: DataFrame) -> str:
    """The registry as {dataset: {table: [columns]}} for small catalogs."""
    out: dict = {}
    for r in reg.orderBy("dataset", "table_name", "ordinal").collect():
        out.setdefault(r.dataset, {}).setdefault(r.table_name, []).append({"name": r.name, "type": r.type, "description": r.description})
    return json.dumps(out, ensure_ascii=False)
