import hashlib
import math
from collections import defaultdict

import pytest

from govlake.llm.mixing import mix_sources

from .helpers import SCHEMA, awkward_rows, frame, words


def fill(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in rest)) if rest else 0
        over = {s for s in rest if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def copies(rows, seed="mix"):
    """How often each document (ids do not repeat) is taken, one boundary after another."""
    sizes, out = defaultdict(int), {}
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = fill(sizes, (5, 2, 1), 1.5, 2.0)
    for s in sizes:
        named = f"{seed}/={s}" if s is not None else f"{seed}/null"
        offset = int(hashlib.md5(named.encode()).hexdigest()[:8], 16) / 2**32
        expected = targets[s] / sizes[s] if sizes[s] else 0.0
        part = expected - math.floor(expected)
        for i, r in enumerate(sorted((r for r in rows if r[3] == s), key=lambda r: (len(words(r[1])), r[0]))):
            out[r[0]] = math.floor(expected) + math.floor((i + 1) * part + offset) - math.floor(i * part + offset)
    return out


def test_copies_against_brute_force(spark):
    rows = [r for i, r in enumerate(awkward_rows()) if r[0] is not None and r[0] == i]
    assert {r.doc_id: r.copies for r in mix_sources(frame(spark, rows)).collect()} == copies(rows)


def test_against_brute_force(spark):
    rows = awkward_rows()
    got = mix_sources(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r[0]), len(words(r[1]))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets, taken, largest = fill(sizes, (5, 2, 1), 1.5, 2.0), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] + 1


def test_reruns_agree(spark):
    rows = awkward_rows()
    one, two = ({(repr(r.doc_id), r.size, r.taken) for r in mix_sources(frame(spark, x)).collect()} for x in (rows, rows[::-1]))
    assert one == two


def test_empty_table_and_empty_texts(spark):
    assert mix_sources(frame(spark, [])).collect() == []
    rows = [(1, None, None, None, 0, 0, 0, True, 0), (2, "", None, "a", 0, 0, 0, True, 0)]
    assert [(r.size, r.target, r.taken) for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 7])
def test_targets_sum_to_share(spark, n):
    rows = [(i, "w " * (i % 5 + 1) ** 3, None, f"s{i % n}", 0, 0, 0, True, 0) for i in range(200)]
    got = {r.source: (r.source_size, r.target) for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert math.isclose(sum(t for _, t in got.values()), 1.5 * sum(s for s, _ in got.values()))


def test_rows_of_the_mix_and_clashing_names(spark):
    from govlake.llm.mixing import mix_rows

    names = ("_n", "_copy", "_rows", "_copies", "_id", "_source", "_size", "row", "size", "copies", "before")
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(40)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mix_rows(df)
    assert mixed.columns == df.columns
    got = [tuple(r) for r in mixed.collect()]
    taken = defaultdict(int)
    for r in mix_sources(df).collect():
        taken[r.doc_id] += r.copies
    assert set(got) <= set(rows) and {d: sum(g[0] == d for g in got) for d in taken} == dict(taken)


def test_many_sources_are_ranked_in_ranges(spark, monkeypatch):
    from govlake.llm import mixing

    rows = [(i, "w " * (i % 9 + 1), None, None if i % 50 == 0 else f"s{i % 50}", 0, 0, 0, True, 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    few = {(r.doc_id, r.target, r.taken) for r in mix_sources(df).collect()}
    monkeypatch.setattr(mixing, "FEW_BYTES", 10)
    assert {(r.doc_id, r.target, r.taken) for r in mix_sources(df).collect()} == few
