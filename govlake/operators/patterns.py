"""Procurement-risk patterns over contracts, bids and establishments.

Each is a function from DataFrames with the columns named below to findings, with its limits in
a frozen dataclass. ``strict`` follows the written definition where the published query is looser.

contracts: year, month, agency_id, agency_name, supplier_id, supplier_name, initial_value,
final_value, signed_on, legal_basis, subject. bids: auction_id, bidder_id, won.
establishments: company_id, founded_on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions.scalars import company_root, safe_div


#: Stems that mark works in a contract's subject (fixed value).
WORKS = "obra|constru|reform|engenhari|paviment|demoli"


def _count() -> Column:
    return F.count(F.lit(1)).cast("long")


def top(found: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first ``n`` findings of a published report, or all of them."""
    return found if n is None else found.orderBy(*order).limit(n)


@dataclass(frozen=True)
class SplitLimits:
    """Direct-purchase limits: up to ``change_year`` the older one (fixed values)."""

    change_year: int = 2023
    before: float = 17_600.0
    after: float = 57_912.0
    least_contracts: int = 3


def split_contracts(contracts: DataFrame, limits: SplitLimits = SplitLimits(), strict: bool = True) -> DataFrame:
    """Months in which an agency's small purchases add up beyond the limit that each stays under."""
    limit = F.when(F.col("year") <= limits.change_year, F.lit(limits.before)).otherwise(F.lit(limits.after))
    rows = contracts.filter(F.col("signed_on").isNotNull() & (F.col("initial_value") > 0))
    if strict:
        rows = rows.filter(F.col("initial_value") < limit)
    found = rows.groupBy("year", "month", "agency_id").agg(_count().alias("n"), F.round(F.sum("initial_value"), 4).alias("total")).withColumn("limit_value", limit)
    return found.filter((F.col("n") >= limits.least_contracts) & (F.col("total") > F.col("limit_value")))


@dataclass(frozen=True)
class ConcentrationLimits:
    least_share: float = 0.40
    least_agency: float = 50_000.0
    least_supplier: float = 10_000.0


def contract_concentration(contracts: DataFrame, limits: ConcentrationLimits = ConcentrationLimits(), strict: bool = True) -> DataFrame:
    """Suppliers with a large share of an agency's spending; one shuffle, the total is a window over the sums."""
    keys = ["agency_id", "agency_name"] if strict else ["agency_id"]
    spent = contracts.groupBy(*keys, "supplier_id").agg(F.sum("initial_value").alias("supplier_total"))
    spent = spent.withColumn("agency_total", F.sum("supplier_total").over(Window.partitionBy(*keys)))
    share = safe_div("supplier_total", "agency_total")
    kept = spent.filter((share > limits.least_share) & (F.col("agency_total") >= limits.least_agency) & (F.col("supplier_total") >= limits.least_supplier))
    return kept.select(*keys, "supplier_id", F.round("supplier_total", 4).alias("supplier_total"), F.round("agency_total", 4).alias("agency_total"), F.round(share * 100, 2).alias("share_pct"))


def inexigibility_recurrence(contracts: DataFrame, basis: str = "inexigibilidade", least_value: float = 1000.0, least_contracts: int = 3) -> DataFrame:
    """Suppliers that an agency hires again and again without competition."""
    rows = contracts.filter((F.lower("legal_basis") == basis.lower()) & (F.col("initial_value") >= least_value))
    return rows.groupBy("agency_id", "supplier_id").agg(_count().alias("n"), F.round(F.sum("initial_value"), 4).alias("total")).filter(F.col("n") >= least_contracts)


def single_bidder(bids: DataFrame, least_occurrences: int = 1) -> DataFrame:
    """Auctions with one distinct bidder, and the winner; optionally only winners with several such."""
    found = bids.groupBy("auction_id").agg(F.countDistinct("bidder_id").cast("long").alias("bidders"), F.max(F.when(F.col("won"), F.col("bidder_id"))).alias("winner_id")).filter("bidders = 1")
    if least_occurrences > 1:
        often = found.groupBy("winner_id").agg(_count().alias("occurrences")).filter(F.col("occurrences") >= least_occurrences)
        found = found.join(often.select("winner_id"), "winner_id", "left_semi")
    return found.select("auction_id", "bidders", "winner_id")


def win_rates(bids: DataFrame, least_bidders: int = 2, least_bids: int = 10) -> DataFrame:
    """bidder_id, bids, wins, win_rate over auctions with competition."""
    contested = bids.groupBy("auction_id").agg(F.countDistinct("bidder_id").alias("n")).filter(F.col("n") >= least_bidders)
    rates = bids.join(contested, "auction_id", "left_semi").groupBy("bidder_id").agg(_count().alias("bids"), F.sum(F.when(F.col("won"), 1).otherwise(0)).cast("long").alias("wins"))
    return rates.filter(F.col("bids") >= least_bids).withColumn("win_rate", F.round(safe_div(F.col("wins") * 100.0, "bids"), 2))


def always_winner(bids: DataFrame, least_rate: float | str = 80.0, least_bidders: int = 2, least_bids: int = 10) -> DataFrame:
    """Bidders that win at least ``least_rate`` percent, or with "q3" more than the third quartile of all rates."""
    rates = win_rates(bids, least_bidders, least_bids)
    if least_rate == "q3":
        third = rates.agg(F.expr("percentile(win_rate, 0.75)").cast("double").alias("_third"))  # one row, of rates with two decimals: 10,001 values at most
        above = rates.join(F.broadcast(third), F.col("win_rate") > F.col("_third"))
        return above.withColumn("threshold", F.round("_third", 4)).drop("_third")
    return rates.filter(F.col("win_rate") >= float(least_rate))


def amendment_inflation(contracts: DataFrame, limit: float = 1.25, works_limit: float = 1.50, works: str = WORKS, cap: float = 10.0, most: int | None = None) -> DataFrame:
    """Contracts whose final value exceeds the legal growth of the initial one (more for works); the ``most`` inflated, or all."""
    is_works = F.lower(F.coalesce("subject", F.lit(""))).rlike(works)
    ratio = safe_div("final_value", "initial_value")
    rows = contracts.filter(F.col("initial_value") > 0).withColumn("ratio", ratio).withColumn("legal_limit", F.when(is_works, works_limit).otherwise(limit))
    return top(rows.filter((F.col("ratio") > F.col("legal_limit")) & (F.col("ratio") <= cap)), most, F.col("ratio").desc())


def newborn_company(establishments: DataFrame, contracts: DataFrame, least_value: float = 50_000.0, most_days: int = 180, root=company_root) -> DataFrame:
    """Companies whose first large contract comes soon after founding; earlier contracts are flagged, not dropped."""
    founded = establishments.groupBy(root("company_id").alias("root")).agg(F.min("founded_on").alias("founded_on"))
    large = contracts.filter((F.col("initial_value") >= least_value) & F.col("signed_on").isNotNull())
    first = large.groupBy(root("supplier_id").alias("root")).agg(F.min("signed_on").alias("first_contract"))
    days = F.datediff("first_contract", "founded_on")
    return founded.join(first, "root").withColumn("days", days.cast("long")).filter(F.col("days") < most_days).withColumn("is_inconsistent", F.col("days") < 0)


def sudden_surge(yearly: DataFrame, least_previous: float = 1_000_000.0, least_ratio: float = 5.0, first_only: bool = False, most: int | None = None) -> DataFrame:
    """supplier, year, total -> years whose total is ``least_ratio`` times the year before's; the ``most`` sudden, or all."""
    w = Window.partitionBy("supplier").orderBy("year")
    rows = yearly.withColumn("previous_year", F.lag("year").over(w)).withColumn("previous", F.lag("total").over(w))
    rows = rows.withColumn("ratio", safe_div("total", F.nullif(F.col("previous"), F.lit(0.0))))
    found = rows.filter((F.col("year") - F.col("previous_year") == 1) & (F.col("previous") > 0) & (F.col("previous") >= least_previous) & (F.col("ratio") >= least_ratio))
    if first_only:
        found = found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return top(found, most, F.col("ratio").desc(), F.col("supplier"), F.col("year"))
