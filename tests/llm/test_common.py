import random

import pytest
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, attach, join_groups, running_totals, slices, word_count


@pytest.mark.parametrize("shards", [1, 3, 4096])
def test_join_groups_is_a_left_join(spark, shards):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 20 + ["a", "b", "c", None, "lost"])) for i in range(400)]
    counts = {}
    for _, k in rows:
        counts[k] = counts.get(k, 0) + 1
    groups = [(k, n, f"v{k}") for k, n in counts.items() if k != "lost"]
    left, right = spark.createDataFrame(rows, "i int, k string"), spark.createDataFrame(groups, "k string, rows long, v string")
    expected = sorted((i, None if k == "lost" else f"v{k}") for i, k in rows)
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.i, r.v) for r in join_groups(left, right, ["k"], "rows", shards).collect()), key=key) == sorted(expected, key=key)
    assert sorted(((r.i, r.v) for r in attach(left, right, ["k"], "rows").collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("grouped", [True, False])
def test_running_totals(spark, grouped):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 9 + ["b", None, "z"]), rng.randrange(50), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, s int, v bigint").repartition(7)
    order = ([F.col("g").asc_nulls_last()] if grouped else []) + [F.col("s").asc(), F.col("i").asc()]
    got = {r.i: r.before for r in running_totals(Scratch(spark, "t"), df, order, "v", "g" if grouped else None).collect()}
    totals, expected = {}, {}
    for i, g, _, v in sorted(rows, key=lambda r: ((r[1] is None, r[1] or "") if grouped else (), r[2], r[0])):
        k = g if grouped else 0
        expected[i] = totals.get(k, 0)
        totals[k] = expected[i] + v
    assert got == expected


def test_word_count_and_slices(spark):
    texts = ["a b", " a\tb\r\n c ", "", None, " x y", "\x1ca b"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_count("t").alias("n")).collect()]
    assert got == [2, 3, 0, 0, 1, 2]
    assert list(slices([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)] and list(slices([], 3)) == []


def test_tables_are_shared_and_dropped(spark, tmp_path):
    scratch = Scratch(spark, "t")
    df = scratch.write(spark.range(5), "x")
    assert df.count() == 5
    path = scratch.paths["x"].removeprefix("file://")
    scratch.drop("x")
    import os

    assert not os.path.exists(path)


def test_measured_bytes_and_release(spark):
    import os

    from govlake.llm.common import measured_bytes, release, written

    before = written()
    scratch = Scratch(spark, "measured")
    small = scratch.write(spark.range(10).selectExpr("id", "cast(id as string) as s", "named_struct('a', id, 'b', 'xyz') as t", "array(id, id) as l"), "small")
    assert 10 * (8 + 8 + 17 + 16 + 8 + 19) <= measured_bytes(small) <= 10 * 200
    assert measured_bytes(small.limit(0)) == 0
    wide = scratch.write(spark.range(10).selectExpr("repeat('é', 1000) as s"), "wide")
    assert 20_000 <= measured_bytes(wide) <= 21_000
    mine = written() - before
    assert mine == {scratch.base} and os.path.exists(scratch.base.removeprefix("file://"))
    release(spark, mine)
    assert written() == before and not os.path.exists(scratch.base.removeprefix("file://"))


def test_rows_are_dropped_and_kept_whatever_their_names(spark, monkeypatch):
    from govlake.llm import common

    rows = [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (None, "a", "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _k_text_key string")
    some = Scratch(spark, "some").write(df.filter("text = 'a' OR text IS NULL").selectExpr("doc_id", "xxhash64(text) as text_key"), "keys")
    for few in (common.FEW_BYTES, 0):  # with a broadcast, and by a shuffle
        monkeypatch.setattr(common, "FEW_BYTES", few)
        dropped, kept = common.drop_rows(df, some), common.keep_rows(df, some)
        assert dropped.columns == kept.columns == df.columns
        assert [tuple(r) for r in dropped.collect()] == [rows[2]]
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, (rows[0], rows[1], rows[3], rows[4])))
