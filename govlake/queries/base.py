"""Registry of queries, and the fixture tables seen as procurement data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

DAY = "CAST({} AS DATE)"


class Tables:
    """Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return fn

        return keep


def wide(t: Tables) -> DataFrame:
    """Line items with order, customer, nation and part: the contract-like view."""
    joined = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    )
    price = F.col("l_extendedprice")
    return joined.withColumns({"ano": F.year("o_orderdate"), "mes": F.month("o_orderdate"), "vi": price * (1 - F.col("l_discount")), "vf": price * (1 + F.col("l_tax"))})


def contracts(t: Tables) -> DataFrame:
    return wide(t).select(
        F.col("ano").alias("year"),
        F.col("mes").alias("month"),
        F.col("c_nationkey").alias("agency_id"),
        F.col("n_name").alias("agency_name"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("vi").alias("initial_value"),
        F.col("vf").alias("final_value"),
        F.col("o_orderdate").cast("date").alias("signed_on"),
        F.col("p_type").alias("legal_basis"),
        F.col("p_name").alias("subject"),
        F.col("l_orderkey").alias("contract_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("o_custkey").alias("customer_id"),
    )


def bids(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("auction_id"), F.col("l_suppkey").alias("bidder_id"), (F.col("l_returnflag") == "R").alias("won"))


#: The same view for the SQL side.
K = """
SELECT l.*, o.*, c.c_custkey, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name, n.n_regionkey, p.p_name, p.p_type, p.p_brand, p.p_size,
  year(o_orderdate) AS ano, month(o_orderdate) AS mes, l_extendedprice * (1 - l_discount) AS vi, l_extendedprice * (1 + l_tax) AS vf
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
JOIN nation n ON c_nationkey = n_nationkey JOIN part p ON l_partkey = p_partkey
"""
WITH_K = f"WITH k AS ({K})"
