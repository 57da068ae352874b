"""Risk patterns, compound analyses and indicators on the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions.scalars import safe_div
from govlake.operators import analyses, indicators, patterns
from govlake.plans import semantic
from govlake.queries.base import WITH_K, Registry, Tables, bids, contracts, wide

REGISTRY = Registry()
q = REGISTRY.add
n_rows = lambda: F.count(F.lit(1)).cast("long")

YEAR = 1997


@q("split_contracts", f"{WITH_K} SELECT ano::INT AS year, mes::INT AS month, c_nationkey AS agency_id, count(*)::BIGINT AS n, round(sum(vi), 4) AS total, 17600.0::DOUBLE AS limit_value FROM k WHERE ano = {YEAR} AND vi > 0 AND vi < 17600 AND o_orderdate IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND sum(vi) > 17600")
def split_contracts(t: Tables) -> DataFrame:
    return patterns.split_contracts(contracts(t).filter(F.col("year") == YEAR))


@q("split_contracts_published", f"{WITH_K} SELECT ano::INT AS year, mes::INT AS month, c_nationkey AS agency_id, count(*)::BIGINT AS n, round(sum(vi), 4) AS total, 17600.0::DOUBLE AS limit_value FROM k WHERE vi > 0 AND o_orderdate IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND sum(vi) > 17600")
def split_published(t: Tables) -> DataFrame:
    return patterns.split_contracts(contracts(t), strict=False)


@q("contract_concentration", f"{WITH_K}, s AS (SELECT c_nationkey AS agency_id, n_name AS agency_name, l_suppkey AS supplier_id, sum(vi) AS st FROM k WHERE ano = {YEAR} GROUP BY 1, 2, 3), a AS (SELECT agency_id, sum(st) AS t FROM s GROUP BY 1) SELECT s.agency_id, agency_name, supplier_id, round(st, 4) AS supplier_total, round(t, 4) AS agency_total, round(st / t * 100, 2) AS share_pct FROM s JOIN a ON s.agency_id = a.agency_id WHERE st / t > 0.03 AND t >= 50000 AND st >= 10000")
def concentration(t: Tables) -> DataFrame:
    return patterns.contract_concentration(contracts(t).filter(F.col("year") == YEAR), patterns.ConcentrationLimits(0.03, 50_000, 10_000))


@q("inexigibility_recurrence", f"{WITH_K} SELECT c_nationkey AS agency_id, l_suppkey AS supplier_id, count(*)::BIGINT AS n, round(sum(vi), 4) AS total FROM k WHERE ano = {YEAR} AND p_type = 'PROMO' AND vi >= 1000 GROUP BY 1, 2 HAVING count(*) >= 3")
def inexigibility(t: Tables) -> DataFrame:
    return patterns.inexigibility_recurrence(contracts(t).filter(F.col("year") == YEAR), basis="PROMO")


@q("single_bidder", "SELECT l_orderkey AS auction_id, count(DISTINCT l_suppkey)::BIGINT AS bidders, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS winner_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def single_bidder(t: Tables) -> DataFrame:
    return patterns.single_bidder(bids(t))


@q("single_bidder_repeated", "WITH s AS (SELECT l_orderkey AS auction_id, count(DISTINCT l_suppkey)::BIGINT AS bidders, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS winner_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) SELECT * FROM s WHERE winner_id IN (SELECT winner_id FROM s GROUP BY 1 HAVING count(*) >= 2)")
def single_bidder_repeated(t: Tables) -> DataFrame:
    return patterns.single_bidder(bids(t), least_occurrences=2)


_RATES = "SELECT l_suppkey AS bidder_id, count(*)::BIGINT AS bids, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS wins, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 2)::DOUBLE AS win_rate FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2) GROUP BY 1 HAVING count(*) >= 10"


@q("always_winner", f"SELECT * FROM ({_RATES}) WHERE win_rate >= 34")
def always_winner(t: Tables) -> DataFrame:
    return patterns.always_winner(bids(t), 34.0)


@q("winrate_q3", f"WITH r AS ({_RATES}), t AS (SELECT round(quantile_cont(win_rate, 0.75), 4) AS threshold, quantile_cont(win_rate, 0.75) AS th FROM r) SELECT r.*, threshold FROM r, t WHERE win_rate > th")
def winrate_q3(t: Tables) -> DataFrame:
    return patterns.always_winner(bids(t), "q3")


_WORKS = "CASE WHEN regexp_matches(lower(subject), 'obra|constru|reform|engenhari|paviment|demoli') THEN 1.50::DOUBLE ELSE 1.25::DOUBLE END"
_GROWN = f"{WITH_K}, g AS (SELECT l_orderkey AS contract_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier_id, 'Demolição de ' || p_name AS subject, vf * 1.3::DOUBLE / vi AS ratio FROM k WHERE vi > 0 AND l_partkey % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Edificação: ' || p_name, vf * 1.3::DOUBLE / vi FROM k WHERE vi > 0 AND l_partkey % 2 = 1)"


def _amended(t: Tables) -> DataFrame:
    """Contracts whose final value has grown by three tenths more, half of them demolitions and half of them no works by the published words."""
    kind = F.when(F.col("part_id") % 2 == 0, "Demolição de ").otherwise("Edificação: ")
    return contracts(t).withColumn("subject", F.concat(kind, "subject")).withColumn("final_value", F.col("final_value") * 1.3)


@q("amendment_inflation", f"{_GROWN} SELECT contract_id, line, part_id, supplier_id, round(ratio, 4) AS ratio, {_WORKS} AS legal_limit FROM g WHERE ratio > {_WORKS} AND ratio <= 10")
def amendment_inflation(t: Tables) -> DataFrame:
    """With the published limits and words."""
    return patterns.amendment_inflation(_amended(t)).select("contract_id", "line", "part_id", "supplier_id", F.round("ratio", 4).alias("ratio"), "legal_limit")


@q("amendment_inflation_top", f"{_GROWN} SELECT round(ratio, 6) AS ratio FROM g WHERE ratio > {_WORKS} AND ratio <= 10 ORDER BY ratio DESC LIMIT 100")
def amendment_top(t: Tables) -> DataFrame:
    """The published report: the hundred most inflated."""
    return patterns.amendment_inflation(_amended(t), most=100).select(F.round("ratio", 6).alias("ratio"))


@q("newborn_company", "WITH f AS (SELECT o_custkey AS root, min(o_orderdate::DATE) AS founded_on FROM orders GROUP BY 1), c AS (SELECT o_custkey AS root, min(l_shipdate::DATE) AS first_contract FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= 50000 GROUP BY 1) SELECT f.root, strftime(founded_on, '%Y-%m-%d') AS founded_on, strftime(first_contract, '%Y-%m-%d') AS first_contract, date_diff('day', founded_on, first_contract)::BIGINT AS days, date_diff('day', founded_on, first_contract) < 0 AS is_inconsistent FROM f JOIN c ON f.root = c.root WHERE date_diff('day', founded_on, first_contract) < 180")
def newborn_company(t: Tables) -> DataFrame:
    companies = t.orders.select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("date").alias("founded_on"))
    first = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("supplier_id"), F.col("l_extendedprice").alias("initial_value"), F.col("l_shipdate").cast("date").alias("signed_on"))
    found = patterns.newborn_company(companies, first, root=F.col)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("founded_on", "first_contract")})


_YEARLY = "SELECT o_custkey AS supplier, year(o_orderdate)::INT AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2"
_SURGE = f"WITH y AS ({_YEARLY}), p AS (SELECT *, lag(year) OVER w AS previous_year, lag(total) OVER w AS previous FROM y WINDOW w AS (PARTITION BY supplier ORDER BY year)) SELECT supplier, year, previous_year, round(total, 2) AS total, round(previous, 2) AS previous, round(total / previous, 4) AS ratio FROM p WHERE year - previous_year = 1 AND previous >= 100000 AND total / previous >= 5"


def _surge(t: Tables, first_only: bool) -> DataFrame:
    yearly = t.orders.groupBy(F.col("o_custkey").alias("supplier"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    found = patterns.sudden_surge(yearly, 100_000, 5.0, first_only)
    return found.select("supplier", "year", "previous_year", F.round("total", 2).alias("total"), F.round("previous", 2).alias("previous"), F.round("ratio", 4).alias("ratio"))


@q("sudden_surge", _SURGE)
def sudden_surge(t: Tables) -> DataFrame:
    return _surge(t, False)


@q("surge_first_only", f"SELECT supplier, year, previous_year, total, previous, ratio FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY year) AS i FROM ({_SURGE})) WHERE i = 1")
def surge_first_only(t: Tables) -> DataFrame:
    return _surge(t, True)


@q("surge_top", f"SELECT ratio FROM ({_SURGE}) ORDER BY ratio DESC LIMIT 100")
def surge_top(t: Tables) -> DataFrame:
    """The published report: the hundred most sudden."""
    yearly = t.orders.groupBy(F.col("o_custkey").alias("supplier"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    return patterns.sudden_surge(yearly, 100_000, 5.0, most=100).select(F.round("ratio", 4).alias("ratio"))


# --- analyses ----------------------------------------------------------------------------


def _section_sql(role: str = "", year: str = "") -> str:
    return f"WITH c AS (SELECT c_custkey, c_mktsegment FROM customer {role}), e AS (SELECT o_custkey, l_suppkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey {year}) SELECT p_type AS section, p_type AS description, count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT o_custkey)::BIGINT AS candidates, count(*)::BIGINT AS transactions, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM e JOIN c ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def _sections(t: Tables, role: str | None = None, first_year: int | None = None) -> DataFrame:
    candidates = t.customer.select(F.col("c_custkey").alias("voter_id"), F.col("c_mktsegment").alias("role"))
    expenses = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("voter_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("sector"), F.year("o_orderdate").alias("year"))
    sections = t.part.select(F.col("p_partkey").alias("sector"), F.col("p_type").alias("section"), F.col("p_type").alias("description"))
    return analyses.section_shares(candidates, expenses, sections, role, first_year)


@q("cnae_share_overall", _section_sql(year="WHERE year(o_orderdate) >= 1996"))
def share_overall(t: Tables) -> DataFrame:
    """Flagship: three-way join, two distinct counts, share of total."""
    return _sections(t, first_year=1996)


@q("cnae_share_by_role", _section_sql(role="WHERE c_mktsegment = 'BUILDING'"))
def share_by_role(t: Tables) -> DataFrame:
    return _sections(t, role="BUILDING")


@q("company_integrity", "SELECT s.s_suppkey, s.s_name, count(DISTINCT s2.s_suppkey)::BIGINT AS other_entities, round(sum(v) / count(DISTINCT s2.s_suppkey), 2) AS total FROM supplier s JOIN supplier s2 ON s.s_nationkey = s2.s_nationkey AND s2.s_suppkey <> s.s_suppkey JOIN (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON l_suppkey = s.s_suppkey GROUP BY 1, 2 HAVING count(DISTINCT s2.s_suppkey) > 2")
def company_integrity(t: Tables) -> DataFrame:
    """Suppliers that share a director (a nation here) with more than two others, and their contract total."""
    totals = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    same = t.supplier.groupBy("s_nationkey").agg(n_rows().alias("k"))  # members of a group instead of its pairs
    others = t.supplier.join(same, "s_nationkey").withColumn("other_entities", F.col("k") - 1).filter("other_entities > 2")
    return others.join(totals, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "other_entities", F.round("v", 2).alias("total"))


@q("company_integrity_top", "SELECT s.s_suppkey, s.s_name, round(max(v), 2) AS total FROM supplier s JOIN supplier s2 ON s.s_nationkey = s2.s_nationkey AND s2.s_suppkey <> s.s_suppkey JOIN (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON l_suppkey = s.s_suppkey GROUP BY 1, 2 HAVING count(DISTINCT s2.s_suppkey) > 2 ORDER BY max(v) DESC, 1 LIMIT 20")
def company_integrity_top(t: Tables) -> DataFrame:
    """The published report: the twenty largest totals."""
    return patterns.top(company_integrity(t), 20, F.col("total").desc(), F.col("s_suppkey")).select("s_suppkey", "s_name", "total")


@q("infrastructure_gap", "SELECT n_nationkey, n_name, n_regionkey, round(coalesce(s, 0) * 1000.0::DOUBLE / NULLIF(c, 0), 2) AS per_thousand FROM nation JOIN (SELECT c_nationkey, count(*)::BIGINT AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, count(*)::BIGINT AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey ORDER BY per_thousand, n_nationkey LIMIT 50")
def infrastructure_gap(t: Tables) -> DataFrame:
    c = t.customer.groupBy("c_nationkey").agg(n_rows().alias("c"))
    s = t.supplier.groupBy("s_nationkey").agg(n_rows().alias("s"))
    both = t.nation.join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rate = F.round(safe_div(F.coalesce("s", F.lit(0)) * 1000.0, "c"), 2)
    return both.select("n_nationkey", "n_name", "n_regionkey", rate.alias("per_thousand")).orderBy("per_thousand", "n_nationkey").limit(50)


_SPEND = "WITH e AS (SELECT o_custkey, min(o_orderdate) AS since, sum(o_totalprice) AS spent FROM orders GROUP BY 1)"


@q("spend_vs_contracts", f"{_SPEND} SELECT e.o_custkey, round(max(spent), 2) AS spent, round(sum(l_extendedprice), 2) AS contracts, count(*)::BIGINT AS n FROM e JOIN orders o ON e.o_custkey = o.o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE year(l_shipdate) > year(since) GROUP BY 1 HAVING sum(l_extendedprice) > 500000")
def spend_vs_contracts(t: Tables) -> DataFrame:
    """Spending is summed before the join, so nothing is counted twice."""
    spent = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"), F.sum("o_totalprice").alias("spent"))
    items = t.lineitem.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("k")), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = spent.join(items, (F.col("o_custkey") == F.col("k")) & (F.year("l_shipdate") > F.year("since")))
    out = joined.groupBy("o_custkey").agg(F.max("spent").alias("spent"), F.sum("l_extendedprice").alias("contracts"), n_rows().alias("n"))
    return out.filter("contracts > 500000").select("o_custkey", F.round("spent", 2).alias("spent"), F.round("contracts", 2).alias("contracts"), "n")


@q("spend_vs_contracts_published", "SELECT o.o_custkey, round(sum(o.o_totalprice), 2) AS spent, round(sum(l_extendedprice), 2) AS contracts FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey JOIN lineitem ON l_orderkey = p.o_orderkey WHERE year(l_shipdate) > year(o.o_orderdate) GROUP BY 1 HAVING sum(l_extendedprice) > 5000000")
def spend_published(t: Tables) -> DataFrame:
    """The published form counts rows several times, as expenses and contracts meet many to many.

    Both are summed by year first, so a customer's years meet instead of its rows, and each sum
    counts as often as the other side has rows.
    """
    o = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("since")).agg(F.sum("o_totalprice").alias("spent"), n_rows().alias("orders"))
    items = t.lineitem.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("k")), F.col("l_orderkey") == F.col("o_orderkey"))
    yearly = items.groupBy("k", F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("price"), n_rows().alias("items"))
    joined = o.join(yearly, (F.col("o_custkey") == F.col("k")) & (F.col("year") > F.col("since")))
    out = joined.groupBy("o_custkey").agg(F.sum(F.col("spent") * F.col("items")).alias("spent"), F.sum(F.col("price") * F.col("orders")).alias("contracts")).filter("contracts > 5000000")
    return out.select("o_custkey", F.round("spent", 2).alias("spent"), F.round("contracts", 2).alias("contracts"))


@q("masked_identity_join", "SELECT c_custkey, s_suppkey FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON upper(a.n_name) = upper(b.n_name) JOIN supplier ON s_nationkey = b.n_nationkey AND lpad((c_custkey % 50)::VARCHAR, 6, '0') = lpad((s_suppkey % 50)::VARCHAR, 6, '0')")
def masked_identity(t: Tables) -> DataFrame:
    """Names in other case, ids masked on one side: both the name and the middle digits decide."""
    digits = lambda c: F.lpad((F.col(c) % 50).cast("string"), 6, "0")
    names = F.broadcast(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))  # a row per nation
    people = t.customer.join(names, F.col("c_nationkey") == F.col("k")).select("c_custkey", F.lower("name").alias("name"), F.concat(F.lit("000"), digits("c_custkey"), F.lit("00")).alias("person_id"))
    partners = t.supplier.join(names, F.col("s_nationkey") == F.col("k")).select("s_suppkey", F.upper("name").alias("partner_name"), F.concat(F.lit("***"), digits("s_suppkey"), F.lit("**")).alias("partner_id"))
    return analyses.masked_identity_join(people, partners).select("c_custkey", "s_suppkey")


@q("owners_in_contracts", f"{WITH_K} SELECT c_custkey::VARCHAR AS person_id, 'n' || c_custkey AS name, lpad(c_custkey::VARCHAR, 8, '0') AS company_id, min(ano)::INT AS first_year, max(ano)::INT AS last_year, count(*)::BIGINT AS items, round(sum(vi), 4) AS total FROM k WHERE vi BETWEEN 10001 AND 500000000 AND c_mktsegment <> 'BUILDING' GROUP BY 1, 2, 3")
def owners(t: Tables) -> DataFrame:
    root = lambda c: F.lpad(c.cast("string"), 8, "0")
    people = t.customer.select(F.col("c_custkey").cast("string").alias("person_id"), F.concat(F.lit("n"), "c_custkey").alias("name"))
    partners = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("N"), "c_custkey").alias("partner_name"), F.col("c_custkey").cast("string").alias("partner_id"), root(F.col("c_custkey")).alias("company_id"))
    items = wide(t).select(F.concat(root(F.col("o_custkey")), F.lit("000100")).alias("supplier_id"), F.col("ano").alias("year"), F.col("vi").alias("value"))
    return analyses.owners_in_contracts(people, partners, items)


_ENTITY = [
    "SELECT 1 AS layer, 'company' AS source, s_name AS finding FROM supplier WHERE s_suppkey = 7",
    "SELECT 2, 'establishments', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 7",
    "SELECT 3, 'partners', s_name FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7) AND s_suppkey <> 7",
    "SELECT 4, 'bids', l_orderkey::VARCHAR FROM lineitem WHERE l_suppkey = 7",
    "SELECT 5, 'contracts', l_orderkey::VARCHAR FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R'",
    "SELECT 6, 'payments', l_orderkey::VARCHAR FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R' AND l_linestatus = 'F'",
    "SELECT 7, 'donations', o_orderkey::VARCHAR FROM orders WHERE o_custkey = 7",
]


@q("investigate_entity", " UNION ALL ".join(_ENTITY))
def investigate_entity(t: Tables) -> DataFrame:
    """From the company over its establishments, partners, bids, contracts and payments to its donations."""
    home = F.broadcast(t.supplier.filter("s_suppkey = 7").select(F.col("s_nationkey").alias("_n")))  # one row
    partners = t.supplier.join(home, F.col("s_nationkey") == F.col("_n"), "left_semi")
    places = t.nation.join(home, F.col("n_nationkey") == F.col("_n"), "left_semi")
    mine, won, line = F.col("l_suppkey") == 7, F.col("l_returnflag") == "R", F.col("l_orderkey")
    found = {
        "company": (t.supplier, F.col("s_suppkey") == 7, F.col("s_name")),
        "establishments": (places, F.lit(True), F.col("n_name")),
        "partners": (partners, F.col("s_suppkey") != 7, F.col("s_name")),
        "bids": (t.lineitem, mine, line),
        "contracts": (t.lineitem, mine & won, line),
        "payments": (t.lineitem, mine & won & (F.col("l_linestatus") == "F"), line),
        "donations": (t.orders, F.col("o_custkey") == 7, F.col("o_orderkey")),
    }
    return analyses.investigate([(name, *found[name]) for name in analyses.LAYERS])


@q("magnitude_flags", "SELECT o_orderkey, o_totalprice, NOT (o_totalprice BETWEEN 1000 AND 250000) AS outlier FROM orders")
def magnitude(t: Tables) -> DataFrame:
    return analyses.magnitude_flags(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 1000.0, 250_000.0)


@q("cosine_select", "WITH v AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id::VARCHAR AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 4) AS similarity FROM embeddings, v WHERE list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) >= 0.35")
def cosine_select(t: Tables) -> DataFrame:
    """The question's vector is a literal, as it is where an embedder gives it."""
    question = t.embeddings.filter("vec_id = 0").select("embedding").first()
    index = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    found = semantic.cosine_select(index, question.embedding if question else [0.0], 0.35)
    return found.select("id", F.round("similarity", 4).alias("similarity"))


# --- indicators --------------------------------------------------------------------------


@q("hhi", f"{WITH_K}, s AS (SELECT n_name, l_suppkey, sum(vi) AS v FROM k GROUP BY 1, 2), p AS (SELECT n_name, v * 100 / sum(v) OVER (PARTITION BY n_name) AS sh FROM s) SELECT n_name, round(sum(sh * sh), 4) AS hhi, CASE WHEN round(sum(sh * sh), 4) > 2500 THEN 'concentrated' WHEN round(sum(sh * sh), 4) < 1000 THEN 'competitive' ELSE 'moderate' END AS market_class FROM p GROUP BY 1")
def hhi(t: Tables) -> DataFrame:
    return indicators.hhi(wide(t), ["n_name"], "l_suppkey", "vi")


@q("gini", "WITH r AS (SELECT c_nationkey, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS i FROM customer WHERE c_acctbal >= 0) SELECT c_nationkey, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0::DOUBLE) / count(*), 6) AS gini FROM r GROUP BY 1")
def gini(t: Tables) -> DataFrame:
    return indicators.gini(t.customer, ["c_nationkey"], "c_acctbal")


@q("pearson_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem GROUP BY 1")
def pearson(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("r"))


@q("execution_rate", f"{WITH_K} SELECT ano::INT AS ano, round(sum(CASE WHEN l_linestatus = 'F' THEN vi ELSE 0 END) * 100.0 / sum(vi), 4) AS pct FROM k GROUP BY 1")
def execution_rate(t: Tables) -> DataFrame:
    paid = F.sum(F.when(F.col("l_linestatus") == "F", F.col("vi")).otherwise(0.0))
    return wide(t).groupBy("ano").agg(F.round(safe_div(paid * 100.0, F.sum("vi")), 4).alias("pct"))


@q("group_ratio", "SELECT o_orderstatus, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / avg(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END), 4) AS ratio FROM orders GROUP BY 1")
def group_ratio(t: Tables) -> DataFrame:
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    return t.orders.groupBy("o_orderstatus").agg(indicators.group_ratio(urgent, low, "o_totalprice").alias("ratio"))


@q("pp_difference", "SELECT n_name, round(100.0::DOUBLE * sum(CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 1 ELSE 0 END) / NULLIF(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END), 0) - 100.0::DOUBLE * sum(CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal > 0 THEN 1 ELSE 0 END) / NULLIF(sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END), 0), 2) AS pp FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pp_difference(t: Tables) -> DataFrame:
    inside, positive = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0
    grouped = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    return grouped.agg(F.round(indicators.rate(positive, inside) - indicators.rate(positive, ~inside), 2).alias("pp"))

