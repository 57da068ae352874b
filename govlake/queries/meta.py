"""Text helpers, money, schema registry, inventories, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions import scalars as fn
from govlake.plans import semantic
from govlake.plans.nlsql import ensure_sql
from govlake.queries.base import Registry, Tables
from govlake.sources import catalog, ingest

REGISTRY = Registry()
q = REGISTRY.add


@q("brl_format", "WITH p AS (SELECT c_custkey, c_acctbal AS v FROM customer) SELECT c_custkey, 'R$ ' || replace(replace(replace(format('{:,.2f}', v), ',', '#'), '.', ','), '#', '.') AS money FROM p")
def brl_format(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.brl("c_acctbal").alias("money"))


@q("age_band", "SELECT CASE WHEN p_size <= 17 THEN '0-17' WHEN p_size <= 24 THEN '18-24' WHEN p_size <= 34 THEN '25-34' WHEN p_size <= 44 THEN '35-44' WHEN p_size <= 54 THEN '45-54' WHEN p_size <= 64 THEN '55-64' ELSE '65+' END AS band, count(*)::BIGINT AS n FROM part GROUP BY 1")
def age_band(t: Tables) -> DataFrame:
    return t.part.groupBy(fn.age_band("p_size").alias("band")).agg(F.count(F.lit(1)).cast("long").alias("n"))


@q("human_size", "SELECT n, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size FROM (SELECT DISTINCT o_orderkey * o_orderkey * 1000 AS n FROM orders)")
def human_size(t: Tables) -> DataFrame:
    sizes = t.orders.select((F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("n")).distinct()
    return sizes.select("n", fn.human_size("n").alias("size"))


@q("digits_only", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 8) AS root, '***' || substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 4, 6) || '**' AS masked FROM customer")
def digits_only(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.digits_only("c_name").alias("digits"), fn.company_root("c_name").alias("root"), fn.mask_person_id("c_name").alias("masked"))


@q("cnpj_valid", "SELECT o_orderkey, regexp_full_match(lpad(o_orderkey::VARCHAR, CASE WHEN o_orderkey % 3 = 0 THEN 14 ELSE 11 END, '0'), '[0-9]{14}') AS valid FROM orders")
def company_id_valid(t: Tables) -> DataFrame:
    text = F.expr("lpad(cast(o_orderkey AS string), CASE WHEN o_orderkey % 3 = 0 THEN 14 ELSE 11 END, '0')")
    return t.orders.select("o_orderkey", fn.is_company_id(text).alias("valid"))


@q("date_diff_days", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days, strftime(o_orderdate, '%Y-%m') AS month FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diff_days(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("days"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@q("string_functions", "SELECT n_nationkey, substr(n_name, 2, 3) AS sub, lower(n_name) AS low, length(n_name)::INT AS len, starts_with(n_name, 'N') AS starts, reverse(n_name) AS rev, split_part(n_name, 'A', 1) AS part, printf('%.2f', n_regionkey::DOUBLE) AS shown, n_name || '-' || n_regionkey AS both FROM nation")
def string_functions(t: Tables) -> DataFrame:
    c = F.col("n_name")
    return t.nation.select("n_nationkey", F.substring(c, 2, 3).alias("sub"), F.lower(c).alias("low"), F.length(c).alias("len"), F.startswith(c, F.lit("N")).alias("starts"), F.reverse(c).alias("rev"), F.split_part(c, F.lit("A"), F.lit(1)).alias("part"), F.format_string("%.2f", F.col("n_regionkey").cast("double")).alias("shown"), F.concat(c, F.lit("-"), F.col("n_regionkey").cast("string")).alias("both"))


@q("code_ranges", "SELECT CASE WHEN p_brand BETWEEN 'Brand#10' AND 'Brand#29' THEN 'low' ELSE 'high' END AS block, count(*)::BIGINT AS n FROM part WHERE p_brand LIKE 'Brand#%' GROUP BY 1")
def code_ranges(t: Tables) -> DataFrame:
    block = F.when(F.col("p_brand").between("Brand#10", "Brand#29"), "low").otherwise("high")
    return t.part.filter(F.col("p_brand").like("Brand#%")).groupBy(block.alias("block")).agg(F.count(F.lit(1)).cast("long").alias("n"))


@q("json_rows", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS json FROM nation")
def json_rows(t: Tables) -> DataFrame:
    return catalog.rows_as_json(t.nation.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@q("csv_render", "SELECT o_orderkey || ',' || coalesce(NULLIF(o_orderstatus, 'F'), '') || ',' || o_orderpriority AS line FROM orders")
def csv_render(t: Tables) -> DataFrame:
    return t.orders.select(fn.csv_line("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")), "o_orderpriority").alias("line"))


@q("text_cleanup", "SELECT doc_id, trim(regexp_replace('<think>' || coalesce(lang, '') || '</think>' || source, '<think(?:ing)?>.*?</think(?:ing)?>', chr(10), 'gs'), ' ' || chr(10)) AS cleaned, replace(source || '''', '''', '''''') AS quoted FROM documents")
def text_cleanup(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("<think>"), F.coalesce("lang", F.lit("")), F.lit("</think>"), F.col("source"))
    cleaned = F.btrim(fn.strip_thinking(reply), F.lit(" \n"))
    return t.documents.select("doc_id", cleaned.alias("cleaned"), fn.quote_text(F.concat("source", F.lit("'"))).alias("quoted"))


#: Messages of a transfer's log, one for each published word and some without any.
_MESSAGES = ("Column type is Not Supported", "unsupported type x", "GEOGRAPHY column", "JSON type", "Access Denied: table", "permission denied", "user is not authorized", "HTTP 403", "Table does not exist", "404 Not found", "timeout", "connection reset", "incompatible versions")


@q("classify_errors", f"WITH m AS (SELECT ([{', '.join(repr(x) for x in _MESSAGES)}])[(doc_id % {len(_MESSAGES)} + 1)::INT] AS message FROM documents) SELECT message, CASE WHEN regexp_matches(message, 'not supported|unsupported type|GEOGRAPHY|JSON type', 'i') THEN 'INCOMPATIBLE' WHEN regexp_matches(message, 'access denied|permission denied|not authorized|403|does not exist|Not found', 'i') THEN 'ACCESS_DENIED' ELSE 'RETRY' END AS class, count(*)::BIGINT AS n FROM m GROUP BY 1, 2")
def classify_errors(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(x) for x in _MESSAGES])
    rows = t.documents.select(F.get(words, (F.col("doc_id") % len(_MESSAGES)).cast("int")).alias("message"))
    return rows.groupBy("message", ingest.classify(F.col("message")).alias("class")).agg(F.count(F.lit(1)).cast("long").alias("n"))


# --- registry: the fixture tables as datasets by their first letter ------------------------

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _registry(t: Tables) -> DataFrame:
    return catalog.registry(t.spark, {f"d{name[0]}.{name}": f"{t.dir}/{name}.parquet" for name in _TABLES})


#: The registry from DuckDB's own view of the tables.
_R = "SELECT 'd' || substr(table_name, 1, 1) AS dataset, table_name, column_index - 1 AS ordinal, column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'TIMESTAMP' ELSE data_type END AS type FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')"


@q("schema_registry", f"SELECT dataset, table_name, ordinal::INT AS ordinal, name, replace(type, '_NTZ', '') AS type FROM ({_R})")
def schema_registry(t: Tables) -> DataFrame:
    return _registry(t).select("dataset", "table_name", "ordinal", "name", F.replace("type", F.lit("_NTZ"), F.lit("")).alias("type"))


_LETTER = "CASE WHEN type LIKE '%STRING%' THEN 'V' WHEN type LIKE '%INT%' THEN 'I' WHEN type LIKE '%DOUBLE%' THEN 'D' WHEN type LIKE '%TIMESTAMP%' THEN 'Ts' ELSE type END"


@q("type_abbrev", f"SELECT name, {_LETTER} AS letter FROM ({_R})")
def type_abbrev(t: Tables) -> DataFrame:
    return _registry(t).select("name", fn.type_abbrev("type").alias("letter"))


@q("schema_prompt", f"SELECT dataset || '.' || table_name AS table_id, dataset || '.' || table_name || ': ' || string_agg(name || ':' || {_LETTER}, ' ' ORDER BY ordinal) AS line FROM ({_R}) GROUP BY dataset, table_name")
def schema_prompt(t: Tables) -> DataFrame:
    return semantic.schema_lines(_registry(t))


@q("registry_counts", f"SELECT count(DISTINCT dataset)::BIGINT AS datasets, count(DISTINCT table_name)::BIGINT AS tables FROM ({_R})")
def registry_counts(t: Tables) -> DataFrame:
    return semantic.registry_counts(_registry(t))


def _shared(reg: DataFrame) -> DataFrame:
    """Columns without their prefix, so that keys have one name in all tables."""
    return reg.withColumn("name", F.regexp_replace("name", "^[a-z]+_", ""))


_S = f"SELECT dataset || '.' || table_name AS t, regexp_replace(name, '^[a-z]+_', '') AS name FROM ({_R})"


@q("join_key_inventory", f"SELECT name, count(DISTINCT t)::BIGINT AS n_tables, array_to_string(list_sort(list(DISTINCT t))[1:10], ', ') AS sample_tables FROM ({_S}) GROUP BY 1 HAVING count(DISTINCT t) > 1")
def join_key_inventory(t: Tables) -> DataFrame:
    return semantic.join_key_inventory(_shared(_registry(t)))


@q("join_hints", f"WITH s AS (SELECT DISTINCT * FROM ({_S})) SELECT a.t AS a, b.t AS b, string_agg(a.name, ', ' ORDER BY a.name) AS keys FROM s a JOIN s b ON a.name = b.name AND a.t < b.t GROUP BY 1, 2")
def join_hints(t: Tables) -> DataFrame:
    return semantic.join_hints(_shared(_registry(t)))


@q("registry_enrich", f"SELECT table_name, name, CASE WHEN name LIKE '%key' THEN 'key ' || name END AS description FROM ({_R})")
def registry_enrich(t: Tables) -> DataFrame:
    reg = _registry(t)
    notes = reg.filter(F.col("name").like("%key")).select(F.col("dataset").alias("dataset_id"), F.col("table_name").alias("table_id"), F.col("name").alias("column_name"), F.concat(F.lit("key "), "name").alias("description_text"))
    return catalog.enrich(reg, notes).select("table_name", "name", "description")


# --- inventories -------------------------------------------------------------------------


def _files(t: Tables) -> DataFrame:
    """Orders as if they were files: a dataset per status, a table per priority."""
    return t.orders.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("table_name"), F.col("o_orderkey").cast("string").alias("path"), F.round("o_totalprice").cast("bigint").alias("bytes"))


@q("inventory_rollup", "SELECT o_orderstatus AS dataset, o_orderpriority AS table_name, count(*)::BIGINT AS files, sum(round(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders GROUP BY ROLLUP (1, 2)")
def inventory_rollup(t: Tables) -> DataFrame:
    return catalog.inventory(_files(t)).drop("size")


@q("cost_estimate", "SELECT round(b, 6) AS gb, round(b / 10, 6) AS least_gb, round(b / 5, 6) AS most_gb, round(b / 10 * 0.08, 8) AS least_usd, round(b / 5 * 0.12, 8) AS most_usd FROM (SELECT sum(round(o_totalprice)::BIGINT)::DOUBLE / 1073741824.0::DOUBLE AS b FROM orders)")
def cost_estimate(t: Tables) -> DataFrame:
    return catalog.cost_estimate(_files(t))


@q("event_log_json", "SELECT event_type, count(*)::BIGINT AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def event_log_json(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@q("ensure_sql", "SELECT 'no tables for that' AS resposta")
def ensured(t: Tables) -> DataFrame:
    return t.spark.sql(ensure_sql("no tables for that"))
