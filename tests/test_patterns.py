from datetime import date

import pytest
from pyspark.sql import functions as F

from govlake.operators import analyses, indicators, patterns

CONTRACTS = "year int, month int, agency_id string, agency_name string, supplier_id string, initial_value double, final_value double, signed_on date, legal_basis string, subject string"
DAY = date(2021, 3, 5)


def contract(agency="a", supplier="11222333000144", value=9000.0, final=None, day=DAY, year=2021, month=3, basis="Inexigibilidade", subject=None, name="Agency"):
    return (year, month, agency, name, supplier, value, final if final is not None else value, day, basis, subject)


def frame(spark, rows):
    return spark.createDataFrame(rows, CONTRACTS)


def test_split_strict_is_within_published(spark):
    rows = [contract() for _ in range(3)] + [contract("b", value=v) for v in (9000.0, 9000.0, 40000.0)]
    rows += [contract("c", day=None) for _ in range(5)] + [contract("d", value=v) for v in (0.0, -5.0, 30000.0)]
    df = frame(spark, rows)
    strict = {r.agency_id for r in patterns.split_contracts(df).collect()}
    published = {r.agency_id for r in patterns.split_contracts(df, strict=False).collect()}
    assert strict == {"a"} and published == {"a", "b"} and strict <= published


def test_split_limit_changes_with_the_year(spark):
    rows = [contract(year=2024, value=17_000.0) for _ in range(3)]
    assert patterns.split_contracts(frame(spark, rows)).collect() == []
    rows = [contract(year=2024, value=20_000.0) for _ in range(3)]
    assert patterns.split_contracts(frame(spark, rows)).first().limit_value == 57_912.0


def test_concentration_by_id_and_name(spark):
    rows = [contract("a", "1", 45_000.0), contract("a", "2", 15_000.0), contract("a", "1", 45_000.0, name="Other")]
    strict = patterns.contract_concentration(frame(spark, rows)).collect()
    loose = patterns.contract_concentration(frame(spark, rows), strict=False).collect()
    assert [(r.agency_name, r.supplier_id, r.share_pct) for r in strict] == [("Agency", "1", 75.0)]
    assert [(r.supplier_id, r.agency_total) for r in loose] == [("1", 105_000.0)]


def test_recurrence_is_case_insensitive(spark):
    df = frame(spark, [contract(value=1000.0) for _ in range(3)] + [contract("b", value=999.0) for _ in range(3)])
    assert [r.agency_id for r in patterns.inexigibility_recurrence(df).collect()] == ["a"]


def test_bidders(spark):
    rows = [("x", "1", True), ("x", "1", False), ("y", "1", True), ("z", "1", True), ("z", "2", True), ("w", "3", False)]
    df = spark.createDataFrame(rows, "auction_id string, bidder_id string, won boolean")
    got = {(r.auction_id, r.winner_id) for r in patterns.single_bidder(df).collect()}
    assert got == {("x", "1"), ("y", "1"), ("w", None)}
    assert {r.auction_id for r in patterns.single_bidder(df, 2).collect()} == {"x", "y"}


def test_always_winner_needs_competition(spark):
    rows = [(f"a{i}", b, b == "1") for i in range(10) for b in ("1", "2")] + [(f"s{i}", "3", True) for i in range(20)]
    df = spark.createDataFrame(rows, "auction_id string, bidder_id string, won boolean")
    assert [(r.bidder_id, r.win_rate) for r in patterns.always_winner(df).collect()] == [("1", 100.0)]
    assert [r.bidder_id for r in patterns.always_winner(df, "q3").collect()] == ["1"]


def test_amendments(spark):
    rows = [contract(value=100.0, final=f, subject=s) for f, s in ((125.0, None), (126.0, None), (140.0, "Obra de reforma"), (151.0, "OBRA"), (1001.0, None))] + [contract(value=0.0, final=10.0)]
    got = {(r.final_value, r.legal_limit) for r in patterns.amendment_inflation(frame(spark, rows)).collect()}
    assert got == {(126.0, 1.25), (151.0, 1.5)}


def test_newborn_strips_all_punctuation_and_keeps_inconsistent(spark):
    est = spark.createDataFrame([("11.222.333/0001-44", date(2021, 1, 1)), ("55666777000188", date(2022, 1, 1)), ("99888777000166", date(2000, 1, 1))], "company_id string, founded_on date")
    rows = [contract(supplier="11222333000144", value=60_000.0), contract(supplier="55.666.777/0001-88", value=60_000.0), contract(supplier="99888777000166", value=60_000.0)]
    got = {(r.root, r.days, r.is_inconsistent) for r in patterns.newborn_company(est, frame(spark, rows)).collect()}
    assert got == {("11222333", 63, False), ("55666777", -302, True)}


def test_surge_needs_consecutive_years(spark):
    rows = [("a", 2019, 1e6), ("a", 2020, 6e6), ("a", 2021, 40e6), ("b", 2018, 1e6), ("b", 2020, 9e6), ("c", 2019, 9e5), ("c", 2020, 9e6), ("d", 2019, 0.0), ("d", 2020, 9e6)]
    df = spark.createDataFrame(rows, "supplier string, year int, total double")
    assert {(r.supplier, r.year) for r in patterns.sudden_surge(df).collect()} == {("a", 2020), ("a", 2021)}
    assert {(r.supplier, r.year) for r in patterns.sudden_surge(df, first_only=True).collect()} == {("a", 2020)}


def test_indicator_ranges(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 1.0), ("n", "a", 5.0), ("o", "a", 0.0)], "market string, firm string, v double")
    got = {r.market: r.hhi for r in indicators.hhi(df, ["market"], "firm", "v").collect()}
    assert got["m"] == 5000.0 and got["n"] == 10_000.0 and got["o"] is None
    equal = spark.createDataFrame([("g", float(i), 10.0) for i in range(4)] + [("h", 0.0, 0.0), ("h", 1.0, 100.0)], "g string, k double, v double")
    gini = {r.g: r.gini for r in indicators.gini(equal, ["g"], "v").collect()}
    assert gini == {"g": 0.0, "h": 0.5}


def test_shares_sum_to_a_hundred(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(1, 9)], "k int, n int")
    assert sum(r.p for r in df.select(indicators.share_of_total(df, "n", digits=6).alias("p")).collect()) == pytest.approx(100)


def test_masked_identity_and_decode(spark):
    people = spark.createDataFrame([("José Ávila", "12345678901"), ("Ana", "00000000000")], "name string, person_id string")
    partners = spark.createDataFrame([("JOSÉ ÁVILA", "***456789**", "c1"), ("JOSÉ ÁVILA", "***456780**", "c2"), ("ANA", "11111111111", "c3")], "partner_name string, partner_id string, company_id string")
    assert [r.company_id for r in analyses.masked_identity_join(people, partners).collect()] == ["c1"]
    book = spark.createDataFrame([("t", "c", "1", "one"), ("t", "d", "1", "wrong")], "table_id string, column_name string, code string, label string")
    df = spark.createDataFrame([(1,), (2,)], "c int")
    assert [tuple(r) for r in analyses.decode(df, book, "t", "c", "label").orderBy("c").collect()] == [(1, "one"), (2, None)]


def test_two_paths(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 10.005), (2, 6.0), (4, 1.0)], "k int, v double")
    got = {r.k: r.agrees for r in analyses.two_path_check(a, b, ["k"], "v").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert analyses.magnitude_flags(a, "v", 2.0, 9.0).filter("outlier").count() == 2
    assert F is not None


def test_ranks_quantiles_and_shares_against_brute_force(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([5.0, 5.0, float(rng.randrange(300)), rng.random() * 1000]), i) for i in range(3000)] + [("c", 7.0, 9001), ("d", None, 9002)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    groups = {}
    for g, v, _ in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    ranked = {(r.g, r.v): (r._rows, r._before) for r in indicators.ranked_values(df, ["g"], "v", parts=8).collect()}
    assert ranked == {(g, v): (vs.count(v), sum(x < v for x in vs)) for g, vs in groups.items() for v in set(vs)}
    for q in (0.0, 0.25, 0.75, 1.0):
        assert {r.g: r["quantile"] for r in indicators.quantile(df, ["g"], "v", q).collect()} == pytest.approx({g: float(np.quantile(vs, q)) for g, vs in groups.items()})

    def gini(vs):
        vs, n = sorted(vs), len(vs)
        return round(2 * sum((i + 1) * v for i, v in enumerate(vs)) / (n * sum(vs)) - (n + 1) / n, 6)

    assert {r.g: r.gini for r in indicators.gini(df, ["g"], "v").collect()} == pytest.approx({g: gini(vs) for g, vs in groups.items()}, abs=2e-6)
    top = {r.g: r.top_share for r in indicators.topn_share(df.filter("v IS NOT NULL"), ["g"], "v", "k", 3).collect()}
    assert top == pytest.approx({g: round(sum(sorted(vs)[-3:]) * 100 / sum(vs), 4) for g, vs in groups.items()}, abs=2e-4)


def test_published_words_and_tops(spark):
    rows = [contract(value=100.0, final=140.0, subject=s) for s in ("Demolição do muro", "Edificação nova", "serviços de engenharia", "REFORMULAR", None)]
    found = patterns.amendment_inflation(frame(spark, rows))
    assert {r.subject for r in found.collect()} == {"Edificação nova", None}
    many = frame(spark, [contract(value=100.0, final=130.0 + i) for i in range(20)])
    assert sorted(r.final_value for r in patterns.amendment_inflation(many, most=3).collect()) == [147.0, 148.0, 149.0]
    yearly = spark.createDataFrame([(f"s{i}", y, 1e6 * (1 if y == 2019 else 6 + i)) for i in range(5) for y in (2019, 2020)], "supplier string, year int, total double")
    assert [r.supplier for r in patterns.sudden_surge(yearly, most=2).collect()] == ["s4", "s3"]
