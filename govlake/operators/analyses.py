"""Compound analyses: market shares, company networks, coded sub-populations, investigations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.functions.scalars import is_company_id, masked_middle
from govlake.operators.indicators import share_of_total


def section_shares(candidates: DataFrame, expenses: DataFrame, sections: DataFrame, role: str | None = None, first_year: int | None = None) -> DataFrame:
    """Distinct suppliers and candidates, transactions and their share by sector of the suppliers.

    candidates (voter_id, role), expenses (voter_id, supplier_id, sector, year), sections (sector,
    section, description). Candidates join on the voter id alone, so several candidacies multiply rows.
    """
    rows = expenses.filter(F.col("sector").isNotNull())
    if first_year is not None:
        rows = rows.filter(F.col("year") >= first_year)
    people = candidates if role is None else candidates.filter(F.col("role") == role)
    joined = rows.join(people.select("voter_id"), "voter_id").join(sections, "sector")
    out = joined.groupBy("section", "description").agg(
        F.countDistinct("supplier_id").cast("long").alias("suppliers"),
        F.countDistinct("voter_id").cast("long").alias("candidates"),
        F.count(F.lit(1)).cast("long").alias("transactions"),
    )
    return out.withColumn("pct", share_of_total(out, "transactions"))


def decode(df: DataFrame, dictionary: DataFrame, table: str, column: str, out: str) -> DataFrame:
    """Add the label of a coded column from a code book (table_id, column_name, code, label)."""
    book = dictionary.filter((F.col("table_id") == table) & (F.col("column_name") == column)).select(F.col("code").alias("_code"), F.col("label").alias(out))
    return df.join(book, F.col(column).cast("string") == F.col("_code"), "left").drop("_code")


def masked_identity_join(people: DataFrame, partners: DataFrame) -> DataFrame:
    """people (name, person_id) with partners (partner_name, partner_id: maybe masked) of equal name and middle digits."""
    on = (F.upper("name") == F.upper("partner_name")) & (masked_middle("person_id") == masked_middle("partner_id"))
    return people.join(partners, on)


def owners_in_contracts(people: DataFrame, partners: DataFrame, contracts: DataFrame, low: float = 10_001.0, high: float = 500e6, excluded: list[str] | None = None) -> DataFrame:
    """First and last year, items and total of each person's companies among the contracts."""
    owned = masked_identity_join(people, partners).select("person_id", "name", "company_id").distinct()
    value = F.col("value").between(low, high)
    items = contracts.filter(value & is_company_id("supplier_id") & ~F.col("supplier_id").isin(excluded or [""]))
    joined = owned.join(items, F.substring("supplier_id", 1, 8) == F.col("company_id"))
    return joined.groupBy("person_id", "name", "company_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).cast("long").alias("items"), F.round(F.sum("value"), 4).alias("total"))


#: Layers of an investigation in the order of search (fixed values).
LAYERS = ("company", "establishments", "partners", "bids", "contracts", "payments", "donations")


def investigate(layers: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """Rows of several tables about one entity: (name, table, condition, what to show) in order of search."""
    found = [df.filter(cond).select(F.lit(i).alias("layer"), F.lit(name).alias("source"), shown.cast("string").alias("finding")) for i, (name, df, cond, shown) in enumerate(layers, 1)]
    return reduce(DataFrame.unionAll, found)


def two_path_check(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """Keys on which two independent computations of ``value`` disagree, or that only one of them has."""
    left, right = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    both = left.join(right, keys, "full_outer")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))


def magnitude_flags(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Flag values outside the expected magnitude."""
    return df.withColumn("outlier", ~F.col(value).between(low, high))
