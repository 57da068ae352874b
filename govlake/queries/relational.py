"""Scans, predicates, joins, aggregation, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions.scalars import percent, safe_div
from govlake.operators.analyses import decode, two_path_check
from govlake.operators.indicators import places, quantile, share_of_total, topn_share, yoy_change
from govlake.plans.sqlgate import Gate
from govlake.queries.base import WITH_K, Registry, Tables, wide

REGISTRY = Registry()
q = REGISTRY.add
n_rows = lambda: F.count(F.lit(1)).cast("long")


# --- scans and predicates ---------------------------------------------------------------


@q("scan_parquet", "SELECT * FROM nation")
def scan_parquet(t: Tables) -> DataFrame:
    return t.nation.select("*")


@q("scan_path_sql", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0")
def scan_path_sql(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT r_regionkey, r_name FROM parquet.`{t.dir}/region.parquet` WHERE r_regionkey > 0")


@q("from_first", "SELECT * FROM region")
def from_first(t: Tables) -> DataFrame:
    return t.spark.sql(f"FROM parquet.`{t.dir}/region.parquet`")


@q("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 300000 AND o_orderstatus <> 'F'")
def filter_range(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.filter((price >= 200000) & (price < 300000) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice")


@q("filter_between", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS ano FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def filter_between(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1999-01-01")).select("o_orderkey", F.year("o_orderdate").alias("ano"))


@q("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)")
def filter_in(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@q("filter_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in(t: Tables) -> DataFrame:
    return t.customer.filter(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@q("null_guard", "SELECT count(*)::BIGINT AS n, count(NULLIF(l_returnflag, 'N'))::BIGINT AS known FROM lineitem WHERE l_shipdate IS NOT NULL AND NULLIF(l_linestatus, 'O') IS NOT NULL")
def null_guard(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(F.col("l_shipdate").isNotNull() & F.nullif(F.col("l_linestatus"), F.lit("O")).isNotNull())
    return rows.agg(n_rows().alias("n"), F.count(F.nullif(F.col("l_returnflag"), F.lit("N"))).cast("long").alias("known"))


@q("filter_like", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_' AND p_name LIKE '%o%'")
def filter_like(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_brand").like("Brand#1_") & F.col("p_name").like("%o%")).select("p_partkey", "p_brand")


@q("filter_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'ring|bolt')")
def filter_regex(t: Tables) -> DataFrame:
    return t.part.filter(F.lower("p_name").rlike("ring|bolt")).select("p_partkey", "p_name")


@q("lower_eq", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def lower_eq(t: Tables) -> DataFrame:
    return t.customer.filter(F.lower("c_mktsegment") == "building").select("c_custkey")


@q("case_when", "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1997 THEN 17600.0::DOUBLE ELSE 57912.0::DOUBLE END AS limit_value, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size_class FROM orders")
def case_when(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    limit = F.when(F.year("o_orderdate") <= 1997, 17600.0).otherwise(57912.0)
    return t.orders.select("o_orderkey", limit.alias("limit_value"), F.when(price > 100000, "large").when(price > 50000, "middle").otherwise("small").alias("size_class"))


@q("where_alias", "SELECT * FROM (SELECT o_orderkey, o_totalprice * 1.1::DOUBLE AS grown FROM orders) WHERE grown > 250000")
def where_alias(t: Tables) -> DataFrame:
    """An alias in WHERE, through the gate."""
    return Gate(t.spark, roots=(t.dir,)).run(f"SELECT o_orderkey, o_totalprice * 1.1D AS grown FROM parquet.`{t.dir}/orders.parquet` WHERE grown > 250000")


@q("literal_relation", "WITH lim(ano, limit_value) AS (VALUES (1996, 17600.0::DOUBLE), (1997, 57912.0::DOUBLE)) SELECT lim.ano, limit_value, count(*)::BIGINT AS n FROM orders JOIN lim ON year(o_orderdate) = lim.ano WHERE o_totalprice > limit_value GROUP BY ALL")
def literal_relation(t: Tables) -> DataFrame:
    limits = t.spark.createDataFrame([(1996, 17600.0), (1997, 57912.0)], "ano int, limit_value double")
    rows = t.orders.withColumn("ano", F.year("o_orderdate")).join(limits, "ano").filter("o_totalprice > limit_value")
    return rows.groupBy("ano", "limit_value").agg(n_rows().alias("n"))


@q("availability_probe", "SELECT min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, count(*)::BIGINT AS n FROM orders")
def availability_probe(t: Tables) -> DataFrame:
    return t.orders.agg(F.year(F.min("o_orderdate")).alias("first_year"), F.year(F.max("o_orderdate")).alias("last_year"), n_rows().alias("n"))


@q("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), b AS (SELECT c_nationkey, max(total) AS top FROM a JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT n_name, round(top, 2) AS top FROM b JOIN nation ON c_nationkey = n_nationkey")
def cte_chain(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    b = a.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max("total").alias("top"))
    return b.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("top", 2).alias("top"))


@q("sample_rows")
def sample_rows(t: Tables) -> DataFrame:
    """A uniform sample of two rows (the feature is the sample)."""
    return t.orders.orderBy(F.rand(7)).limit(2)


# --- joins ------------------------------------------------------------------------------


@q("join_dim", "SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_dim(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(n_rows().alias("n"))


@q("join_composite", "SELECT o.o_custkey, o.y, o.total, p.n FROM (SELECT o_custkey, year(o_orderdate)::INT AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) o JOIN (SELECT o_custkey, year(l_shipdate)::INT AS y, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) p ON o.o_custkey = p.o_custkey AND o.y = p.y")
def join_composite(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    shipped = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", F.year("l_shipdate").alias("y")).agg(n_rows().alias("n"))
    return totals.join(shipped, ["o_custkey", "y"])


@q("join_on_literal", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND year(o_orderdate) = 1998 WHERE c_nationkey = 5")
def join_on_literal(t: Tables) -> DataFrame:
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.year("o_orderdate") == 1998)
    return t.customer.filter("c_nationkey = 5").join(t.orders, on).select("c_custkey", "o_orderkey")


@q("self_join_prev_year", "WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS ano, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) SELECT a.o_custkey, round(a.total, 2) AS total, round(b.total, 2) AS before FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.ano = a.ano - 1 WHERE a.ano = 1998")
def self_join_prev_year(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("ano")).agg(F.sum("o_totalprice").alias("total"))
    a, b = y.filter("ano = 1998").alias("a"), y.alias("b")
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("b.ano") == F.col("a.ano") - 1)).select("a.o_custkey", F.round("a.total", 2).alias("total"), F.round("b.total", 2).alias("before"))


@q("self_join_inequality", "SELECT a.s_suppkey, count(*)::BIGINT AS others, min(b.s_suppkey) AS first_other, max(b.s_suppkey) AS last_other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1")
def self_join_inequality(t: Tables) -> DataFrame:
    """What a row's pairs with the others of its group come to, from the group's two first and two last keys instead of its pairs."""
    w = lambda order: Window.partitionBy("s_nationkey").orderBy(order)
    ends = lambda order, n: F.row_number().over(w(order)).alias(n)
    keys, key = t.supplier.select("s_nationkey", "s_suppkey"), F.col("s_suppkey")
    first = keys.select("*", ends(key.asc(), "i")).filter("i <= 2").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"))
    last = keys.select("*", ends(key.desc(), "i")).filter("i <= 2").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("z"), F.min("s_suppkey").alias("y"))
    sizes = keys.groupBy("s_nationkey").agg(n_rows().alias("k")).filter("k > 1")
    both = keys.join(sizes, "s_nationkey").join(first, "s_nationkey").join(last, "s_nationkey")
    return both.select("s_suppkey", (F.col("k") - 1).alias("others"), F.when(key == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("first_other"), F.when(key == F.col("z"), F.col("y")).otherwise(F.col("z")).alias("last_other"))


@q("expr_key_join", "SELECT s_suppkey, count(*)::BIGINT AS n FROM supplier JOIN customer ON right(s_name, 3) = right(c_name, 3) GROUP BY 1")
def expr_key_join(t: Tables) -> DataFrame:
    """Counted by key before the join, so the join is many to one."""
    suffixes = t.customer.groupBy(F.right("c_name", F.lit(3)).alias("suffix")).agg(n_rows().alias("n"))
    return t.supplier.join(suffixes, F.right("s_name", F.lit(3)) == F.col("suffix")).select("s_suppkey", "n")


@q("range_residual_join", "SELECT o_orderkey, count(*)::BIGINT AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 30 DAY GROUP BY 1")
def range_residual_join(t: Tables) -> DataFrame:
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return t.orders.join(t.lineitem, on).groupBy("o_orderkey").agg(n_rows().alias("late"))


_BOOK = [("orders", "o_orderstatus", "F", "finished"), ("orders", "o_orderstatus", "O", "open"), ("lineitem", "l_linestatus", "F", "other"), ("orders", "o_orderpriority", "F", "wrong column")]


@q("dictionary_decode", "WITH book(code, label) AS (VALUES ('F', 'finished'), ('O', 'open')) SELECT label AS status, count(*)::BIGINT AS n FROM orders LEFT JOIN book ON o_orderstatus = code GROUP BY 1")
def dictionary_decode(t: Tables) -> DataFrame:
    book = t.spark.createDataFrame(_BOOK, "table_id string, column_name string, code string, label string")
    return decode(t.orders, book, "orders", "o_orderstatus", "status").groupBy("status").agg(n_rows().alias("n"))


@q("agg_then_join", "SELECT c_custkey, c_name, n, total FROM customer JOIN (SELECT o_custkey, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def agg_then_join(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(n_rows().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n", "total")


@q("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@q("parent_child_filter", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(CASE WHEN l_quantity > 25 THEN 100.0 ELSE 0.0 END)::DOUBLE, 2) AS pct_large FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2")
def parent_child_filter(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    large = F.round(F.avg(F.when(F.col("l_quantity") > 25, 100.0).otherwise(0.0)), 2)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(n_rows().alias("n"), large.alias("pct_large"))


@q("conditional_split", "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'other' END AS part, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def conditional_split(t: Tables) -> DataFrame:
    part = F.when(F.col("c_mktsegment") == "BUILDING", "building").otherwise("other")
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(part.alias("part"), "n_name").agg(n_rows().alias("n"))


@q("left_enrich", "SELECT n_nationkey, coalesce(top, 'none') AS description FROM nation LEFT JOIN (SELECT s_nationkey, max(s_name) AS top FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def left_enrich(t: Tables) -> DataFrame:
    top = t.supplier.groupBy("s_nationkey").agg(F.max("s_name").alias("top"))
    return t.nation.join(top, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("top", F.lit("none")).alias("description"))


@q("resume_antijoin", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(t: Tables) -> DataFrame:
    done = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")
    return t.orders.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@q("reconcile_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS source_n, b.n AS target_n FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def reconcile_full_outer(t: Tables) -> DataFrame:
    from govlake.sources.ingest import reconcile

    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(n_rows().alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(n_rows().alias("n"))
    return reconcile(a, b, ["k"])


@q("two_path_check", "WITH a AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS v FROM orders), b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS a, b.v AS b, coalesce(abs(a.v - b.v) <= 1000, false) AS agrees FROM a FULL JOIN b ON a.k = b.k")
def two_paths(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("v"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return two_path_check(a, b, ["k"], "v", 1000.0)


# --- aggregation ------------------------------------------------------------------------


@q("cast_sum", "SELECT sum(CAST(CAST(l_quantity AS INT)::VARCHAR AS BIGINT))::BIGINT AS total, count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem")
def cast_sum(t: Tables) -> DataFrame:
    text = F.col("l_quantity").cast("int").cast("string")
    return t.lineitem.agg(F.sum(text.cast("bigint")).alias("total"), F.countDistinct("l_suppkey").cast("long").alias("suppliers"), F.countDistinct("l_partkey").cast("long").alias("parts"))


@q("avg_cast", "SELECT l_returnflag, round(avg(CAST(l_linenumber AS DOUBLE)), 4) AS mean_line, round(avg(l_discount), 4) AS mean_discount FROM lineitem GROUP BY 1")
def avg_cast(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_linenumber").cast("double")), 4).alias("mean_line"), F.round(F.avg("l_discount"), 4).alias("mean_discount"))


@q("having_alias", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_alias(t: Tables) -> DataFrame:
    """An alias in HAVING, through the gate."""
    return Gate(t.spark, roots=(t.dir,)).run(f"SELECT o_custkey, count(*) AS n FROM parquet.`{t.dir}/orders.parquet` GROUP BY 1 HAVING n > 12")


@q("group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def group_by_ordinal(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM parquet.`{t.dir}/orders.parquet` GROUP BY 1, 2")


@q("group_hidden_col", "SELECT n_name, round(sum(c_acctbal) / (n_regionkey + 1), 2) AS per_region FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, n_regionkey")
def group_hidden_col(t: Tables) -> DataFrame:
    grouped = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_regionkey").agg(F.sum("c_acctbal").alias("s"))
    return grouped.select("n_name", F.round(F.col("s") / (F.col("n_regionkey") + 1), 2).alias("per_region"))


@q("census_sum_cols", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(sum(l_quantity + NULLIF(l_tax, 0) + l_discount), 4) AS total FROM lineitem GROUP BY 1")
def census_sum_cols(t: Tables) -> DataFrame:
    total = F.col("l_quantity") + F.nullif(F.col("l_tax"), F.lit(0.0)) + F.col("l_discount")
    return t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(total), 4).alias("total"))


@q("ratio_of_sums", "SELECT l_returnflag, round(100.0 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS pct, round(100.0 - 100.0 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS rest FROM lineitem GROUP BY 1")
def ratio_of_sums(t: Tables) -> DataFrame:
    share = safe_div(F.sum(F.col("l_extendedprice") * F.col("l_discount")) * 100.0, F.sum("l_extendedprice"))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(share, 4).alias("pct"), F.round(100.0 - share, 4).alias("rest"))


@q("per_capita", "SELECT n_name, round(s * 1000.0 / NULLIF(c, 0), 2) AS per_thousand FROM nation LEFT JOIN (SELECT s_nationkey, count(*)::DOUBLE AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, count(*)::DOUBLE AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def per_capita(t: Tables) -> DataFrame:
    s = t.supplier.groupBy("s_nationkey").agg(n_rows().alias("s"))
    c = t.customer.groupBy("c_nationkey").agg(n_rows().alias("c"))
    both = t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return both.select("n_name", F.round(safe_div(F.col("s") * 1000.0, "c"), 2).alias("per_thousand"))


@q("conditional_max", "SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS winner, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS wins FROM lineitem GROUP BY 1")
def conditional_max(t: Tables) -> DataFrame:
    won = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_orderkey").agg(F.max(F.when(won, F.col("l_suppkey"))).alias("winner"), F.count_if(won).cast("long").alias("wins"))


@q("crosstab", "SELECT c_mktsegment, n_regionkey, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def crosstab(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg(n_rows().alias("n"))


@q("crosstab_pivot", "SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2) AS f, round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 2) AS o, round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) / avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 4) AS gap FROM lineitem GROUP BY 1")
def crosstab_pivot(t: Tables) -> DataFrame:
    wide_ = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_extendedprice"))
    return wide_.select("l_returnflag", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), F.round(safe_div("F", "O"), 4).alias("gap"))


@q("rollup_total", "SELECT coalesce(c_mktsegment, 'Total') AS segment, count(*)::BIGINT AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 2)::DOUBLE AS pct FROM customer GROUP BY ROLLUP (c_mktsegment)")
def rollup_total(t: Tables) -> DataFrame:
    grouped = t.customer.rollup("c_mktsegment").agg(n_rows().alias("n"))
    whole = F.max("n").over(Window.partitionBy())  # a row per segment and the total
    return grouped.select(F.coalesce("c_mktsegment", F.lit("Total")).alias("segment"), "n", F.round(safe_div(F.col("n") * 100.0, whole), 2).alias("pct"))


@q("variance", "SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v_samp, round(var_pop(l_quantity), 4) AS v_pop FROM lineitem GROUP BY 1")
def variance(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.var_samp("l_quantity"), 4).alias("v_samp"), F.round(F.var_pop("l_quantity"), 4).alias("v_pop"))


@q("quantile_threshold", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def quantile_threshold(t: Tables) -> DataFrame:
    return quantile(t.orders, ["o_orderpriority"], "o_totalprice", 0.75).select("o_orderpriority", F.round("quantile", 4).alias("q3"))


# --- windows, sorting, top-k ---------------------------------------------------------------


@q("window_share", "SELECT c_mktsegment, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM customer GROUP BY 1")
def window_share(t: Tables) -> DataFrame:
    grouped = t.customer.groupBy("c_mktsegment").agg(n_rows().alias("n"))
    return grouped.select("c_mktsegment", share_of_total(grouped, "n").alias("pct"))


@q("rank_within_group", "WITH s AS (SELECT n_regionkey, n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT *, rank() OVER (PARTITION BY n_regionkey ORDER BY total DESC)::INT AS place, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY total DESC)::INT AS dense FROM s")
def rank_within_group(t: Tables) -> DataFrame:
    s = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    w = Window.partitionBy("n_regionkey").orderBy(F.col("total").desc())
    return s.withColumn("place", F.rank().over(w)).withColumn("dense", F.dense_rank().over(w))


@q("yoy_change", "WITH y AS (SELECT c_nationkey, year(o_orderdate)::INT AS ano, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT *, CASE WHEN ano - lag(ano) OVER w = 1 THEN lag(total) OVER w END AS previous FROM y WINDOW w AS (PARTITION BY c_nationkey ORDER BY ano)) SELECT *, round((total - previous) * 100.0 / NULLIF(previous, 0), 2) AS change_pct FROM p")
def yoy(t: Tables) -> DataFrame:
    y = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("ano")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return yoy_change(y, ["c_nationkey"], "ano", "total")


@q("cumulative_share", "WITH s AS (SELECT c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY 1) SELECT c_nationkey, n, round(sum(n) OVER (ORDER BY n DESC, c_nationkey ROWS UNBOUNDED PRECEDING) * 100.0 / sum(n) OVER (), 4)::DOUBLE AS running_pct FROM s")
def cumulative_share(t: Tables) -> DataFrame:
    s = t.customer.groupBy("c_nationkey").agg(n_rows().alias("n"))
    running = F.sum("n").over(Window.orderBy(F.col("n").desc(), "c_nationkey").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("running_pct", F.round(safe_div(running * 100.0, F.sum("n").over(Window.partitionBy())), 4))


@q("topn_share", "WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal + 1000 AS v FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC, c_custkey) AS i FROM s) SELECT c_nationkey, round(sum(CASE WHEN i <= 3 THEN v ELSE 0 END) * 100.0 / sum(v), 4) AS top_share FROM r GROUP BY 1")
def top_share(t: Tables) -> DataFrame:
    return topn_share(t.customer.withColumn("v", F.col("c_acctbal") + 1000), ["c_nationkey"], "v", "c_custkey", 3)


@q("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@q("null_order", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS status, rank() OVER (ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey)::BIGINT AS place FROM orders")
def null_order(t: Tables) -> DataFrame:
    """The whole table in order, nulls last; ``place`` shows the order, which a comparison of rows would not."""
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return places(rows, "status", F.col("status").desc_nulls_last(), "o_orderkey")


@q("order_by_ordinal", "SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_name)::BIGINT AS place FROM nation")
def order_by_ordinal(t: Tables) -> DataFrame:
    """Sorted by ordinals, and numbered as the rows come (a table of few rows, in one task)."""
    ordered = t.spark.sql(f"SELECT n_name, n_regionkey FROM parquet.`{t.dir}/nation.parquet` ORDER BY 2, 1").coalesce(1)
    return ordered.withColumn("place", F.monotonically_increasing_id() + 1)


@q("multi_key_sort", "SELECT s_suppkey, s_nationkey, s_acctbal, rank() OVER (ORDER BY s_nationkey, s_acctbal DESC)::BIGINT AS place FROM supplier")
def multi_key_sort(t: Tables) -> DataFrame:
    """Nations ascending, balances descending in each; suppliers of equal balance share a place."""
    rows = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal", (-F.col("s_acctbal")).alias("owed"))
    return places(rows, "s_nationkey", F.col("s_nationkey").asc(), "owed").drop("owed")


# --- set operations ---------------------------------------------------------------------


@q("union_labels", "SELECT 'customers' AS kind, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'suppliers', count(*)::BIGINT FROM supplier")
def union_labels(t: Tables) -> DataFrame:
    label = lambda df, name: df.agg(n_rows().alias("n")).select(F.lit(name).alias("kind"), "n")
    return label(t.customer, "customers").unionAll(label(t.supplier, "suppliers"))


@q("union_topk", "SELECT * FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer ORDER BY 2 DESC, 1 LIMIT 5) UNION ALL SELECT * FROM (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier ORDER BY 2 DESC, 1 LIMIT 5)")
def union_topk(t: Tables) -> DataFrame:
    top = lambda df, p: df.select(F.col(f"{p}key").alias("k"), F.col(f"{p[0]}_acctbal").alias("v")).orderBy(F.col("v").desc(), "k").limit(5)
    return top(t.customer, "c_cust").unionAll(top(t.supplier, "s_supp"))


@q("union_by_name", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_by_name(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    b = t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@q("distinct_ids", "SELECT DISTINCT l_suppkey, year(l_shipdate)::INT AS ano FROM lineitem")
def distinct_ids(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("ano")).distinct()


@q("list_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def list_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@q("star_join", f"{WITH_K} SELECT ano, n_name, p_type, count(*)::BIGINT AS n, round(sum(vi), 4) AS total, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100.0 / count(*), 2)::DOUBLE AS pct_returned FROM k GROUP BY 1, 2, 3")
def star_join(t: Tables) -> DataFrame:
    returned = percent(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), F.count(F.lit(1)))
    out = wide(t).groupBy("ano", "n_name", "p_type").agg(n_rows().alias("n"), F.round(F.sum("vi"), 4).alias("total"), returned.alias("pct_returned"))
    return out.withColumn("ano", F.col("ano").cast("long"))
