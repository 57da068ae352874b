"""Indicators over grouped tables: concentration, inequality, shares, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions.scalars import safe_div


def hhi(df: DataFrame, market: list[str], firm: str, value: str) -> DataFrame:
    """Herfindahl-Hirschman index of each market, in (0, 10000], and its class."""
    spent = df.groupBy(*market, firm).agg(F.sum(value).alias("_v"))
    share = safe_div(F.col("_v") * 100, F.sum("_v").over(Window.partitionBy(*market)))
    out = spent.withColumn("_s", share * share).groupBy(*market).agg(F.round(F.sum("_s"), 4).alias("hhi"))
    return out.withColumn("market_class", F.when(F.col("hhi") > 2500, "concentrated").when(F.col("hhi") < 1000, "competitive").otherwise("moderate"))


def ranked_values(df: DataFrame, group: list[str], value: str, parts: int = 256) -> DataFrame:
    """group, value, _rows, _before: the distinct values of each group, how often each occurs, and how many rows of the group are smaller.

    No group is sorted in one task: equal values become one row, quantiles (of a sketch that merges)
    cut each group into ``parts`` ranges, rows are counted inside ranges, and only the ranges'
    totals are summed in order. The result is exact, whatever the sketch's error.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_rows"))
    cuts = df.groupBy(*group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("_cuts"))
    mine = cuts.select(*[F.col(g).alias(f"_c_{g}") for g in group], "_cuts")
    on = F.lit(True)
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    placed = counted.join(mine, on).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts", *[f"_c_{g}" for g in group])
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*group, "_range").agg(F.sum("_rows").alias("_total"))  # at most ``parts`` rows a group
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_range").alias("_o_range"), before.alias("_offset"))
    on = F.col("_range") == F.col("_o_range")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    local = placed.withColumn("_local", F.sum("_rows").over(inside) - F.col("_rows"))
    return local.join(offsets, on).select(*group, value, "_rows", (F.col("_local") + F.col("_offset")).alias("_before"))


def places(df: DataFrame, first: str, order: Column, value: str) -> DataFrame:
    """``df`` with ``place``: the rank of each row (1 first, equals alike) by ``first`` in ``order``, then by ascending ``value``.

    The whole table is ranked, but no task sorts it: values are ranked by ranges within each ``first``,
    and only the sizes of its groups are summed in order.
    """
    ranked = ranked_values(df, [first], value).select(F.col(first).alias("_f"), F.col(value).alias("_v"), "_before")
    sizes = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(first).alias("_s"), offset.alias("_start"))  # a row per group
    known = ranked.join(starts, F.col("_f").eqNullSafe(F.col("_s")))
    placed = df.join(known, F.col(first).eqNullSafe(F.col("_f")) & (F.col(value) == F.col("_v")))
    return placed.select(*df.columns, (F.col("_start") + F.col("_before") + 1).cast("long").alias("place"))


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Gini coefficient of the non-negative ``value`` in each group; equal values share their ranks."""
    ranked = ranked_values(df.filter(F.col(value) >= 0), group, value)
    k = F.col("_rows").cast("double")
    ranks = k * F.col("_before") + k * (k + 1) / 2  # the sum of the ranks of equal values
    n, total, weighted = F.sum(k), F.sum(k * F.col(value)), F.sum(ranks * F.col(value))
    return ranked.groupBy(*group).agg(F.round(safe_div(weighted * 2, n * total) - safe_div(n + 1, n), 6).alias("gini"))


def quantile(df: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """The exact, interpolated quantile ``q`` of each group, as ``quantile``."""
    ranked = ranked_values(df, group, value)
    sizes = ranked.groupBy(*group).agg(F.sum("_rows").alias("_n")).select(*[F.col(g).alias(f"_n_{g}") for g in group], ((F.col("_n") - 1) * F.lit(q)).alias("_at"))
    on = F.lit(True)
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_n_{g}"))
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_rows"))
    found = ranked.join(sizes, on).filter(holds(low) | holds(high))  # two rows a group at most
    a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
    return found.groupBy(*group).agg((a + (b - a) * F.max(F.col("_at") - low)).alias("quantile"))


def share_of_total(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 2) -> Column:
    """Percent of ``value`` in the whole or in its group ``by``; a window over rows that are already aggregated."""
    return F.round(safe_div(F.col(value).cast("double") * 100.0, F.sum(value).over(Window.partitionBy(*(by or [])))), digits)


def topn_share(df: DataFrame, group: list[str], value: str, tie: str, n: int) -> DataFrame:
    """Share of each group's total that its ``n`` largest rows hold; tasks drop all but ``n`` rows of a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), F.col(tie).asc())
    largest = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy(*group).agg(F.sum(value).alias("_top"))
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    both = totals.unionByName(largest, allowMissingColumns=True).groupBy(*group).agg(F.sum("_top").alias("_top"), F.sum("_total").alias("_total"))
    return both.select(*group, F.round(safe_div(F.col("_top") * 100.0, "_total"), 4).alias("top_share"))


def yoy_change(df: DataFrame, key: list[str], year: str, value: str) -> DataFrame:
    """Percent change against the year before; null after a gap."""
    w = Window.partitionBy(*key).orderBy(year)
    before = F.when(F.col(year) - F.lag(year).over(w) == 1, F.lag(value).over(w))
    return df.withColumn("previous", before).withColumn("change_pct", F.round(safe_div((F.col(value) - F.col("previous")) * 100.0, "previous"), 2))


def group_ratio(condition_a: Column, condition_b: Column, value: str) -> Column:
    """Mean of ``value`` where a over its mean where b."""
    return F.round(safe_div(F.avg(F.when(condition_a, F.col(value))), F.avg(F.when(condition_b, F.col(value)))), 4)


def rate(condition: Column, within: Column | None = None) -> Column:
    """Percent of rows (of those ``within``) that meet a condition."""
    base = within if within is not None else F.lit(True)
    return safe_div(F.sum(F.when(base & condition, 1).otherwise(0)) * 100.0, F.sum(F.when(base, 1).otherwise(0)))
