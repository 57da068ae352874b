import random

import numpy as np
import pytest

from govlake.llm import near_duplicates as nd

from .helpers import awkward_rows, frame, prose, words


def sets(rows, k):
    out = []
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, percent=80):
    """Component of every row, by its smallest doc_id; all pairs that share a shingle are compared."""
    shingles, parent = sets(rows, k), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(shingles):
        for x in s:
            holders.setdefault(x, []).append(i)
    tried = set()
    for some in holders.values():
        for a in range(len(some)):
            for b in range(a):
                pair = some[b], some[a]
                if pair not in tried:
                    tried.add(pair)
                    x, y = shingles[pair[0]], shingles[pair[1]]
                    if 100 * len(x & y) >= percent * len(x | y):
                        parent[root(pair[0])] = root(pair[1])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(shingles[i]), least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def got(df, k):
    rows = nd.near_duplicates(df, shingle=k).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def build(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.choice([3, 6, 12, 40, 150, 600])).split()
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5, len(base) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(["Xx", "yy", "zz%d" % rng.randrange(99)])
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.75, 1)))]
            base = copy if rng.random() < 0.4 else base  # chains
            texts.append(" ".join(copy))
    boiler = prose(rng, 60)
    texts += [boiler + " " + prose(rng, rng.choice([10, 15, 18, 25])) for _ in range(30)]
    rng.shuffle(texts)
    return [(i * 3, t, None, None, 0, 0, 0, True, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "k", "often"), [(1, 2, 0), (2, 5, 10**9)])
def test_against_brute_force(spark, monkeypatch, seed, k, often):
    monkeypatch.setattr(nd, "MET_OFTEN", often)
    rows = build(seed)
    assert got(frame(spark, rows), k) == brute(rows, k)


def test_awkward_rows(spark):
    rows = awkward_rows(n=30)
    assert got(frame(spark, rows), 2) == brute(rows, 2)


def test_drop_keeps_columns(spark):
    rows = build(3)
    df = frame(spark, rows)
    kept = nd.drop_near_duplicates(df, 5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows, 5) if d == c)


def test_no_text_at_all(spark):
    rows = [(i, t, None, None, 0, 0, 0, True, 0) for i, t in enumerate([None, "", " \n"])]
    assert got(frame(spark, rows), 5) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert got(frame(spark, []), 5) == []


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        found = []
        for _ in range(40):
            common, n = rng.integers(0, 2**64, 3000, dtype=np.uint64), int(3000 * (1 - share) / share / 2)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, n, dtype=np.uint64)])) for _ in range(2))
            x, y = nd.sketch(a)[None], nd.sketch(b)[None]
            found.append(nd.estimates(x, y, np.array([len(a)]), np.array([len(b)]))[0][0])
        assert abs(np.mean(found) - share) < 0.02


def test_similar_sets_share_a_bucket():
    rng = np.random.default_rng(2)
    for size in (5, 20, 100, 1000):
        for _ in range(150):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            b = np.sort(rng.choice(a, int(np.ceil(0.8 * len(a))), replace=False))
            assert set(nd.bands(nd.sketch(a))) & set(nd.bands(nd.sketch(b)))


def test_similar_sets_share_a_bucket_where_registers_just_fill():
    rng = np.random.default_rng(4)
    for size in (1200, 1400, 1700, 2000, 2500):
        for similarity in (0.8, 0.82, 0.95, 0.99):
            for _ in range(100):
                union = rng.permutation(np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)))
                both = int(np.ceil(similarity * len(union)))
                a, b = (np.sort(np.concatenate([union[:both], union[both + side :: 2]])) for side in (0, 1))
                assert set(nd.bands(nd.sketch(a))) & set(nd.bands(nd.sketch(b))), (size, similarity)


def test_estimates_hardly_ever_reject_a_link():
    rng = np.random.default_rng(3)
    for size in (3, 10, 60, 150, 500, 3000):
        worst = 9.0
        for _ in range(400):
            union = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            both = rng.permutation(len(union)) < int(np.ceil(0.8 * len(union)))
            rest = np.flatnonzero(~both)
            mine = rng.random(len(rest)) < rng.random()
            a, b = np.sort(union[np.concatenate([np.flatnonzero(both), rest[mine]])]), np.sort(union[np.concatenate([np.flatnonzero(both), rest[~mine]])])
            found, error = nd.estimates(nd.sketch(a)[None], nd.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))
            worst = min(worst, float((found[0] + nd.DOUBT * error[0] - 0.8) / error[0]))
        assert worst > 0.5, size


def test_large_sets_against_brute_force(spark):
    """Sets on both sides of the size at which all registers of a sketch are in use."""
    rng = random.Random(9)
    texts = []
    for n in (600, 1000, 1200, 1400, 1700, 2000, 2500, 3000):
        base = [f"w{n}x{i}" for i in range(n)]
        for share in (0.0, 0.04, 0.05, 0.055, 0.06, 0.1):  # two-word shingles: a changed word costs two
            copy = list(base)
            for i in rng.sample(range(n), int(n * share)):
                copy[i] = f"c{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base + [f"t{i}" for i in range(n // 5)]))
    rows = [(i, t, None, None, 0, 0, 0, True, 0) for i, t in enumerate(rng.sample(texts, len(texts)))]
    assert got(frame(spark, rows), 2) == brute(rows, 2)


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve", "thirteen fourteen fifteen sixteen seventeen"
    near = a + " " + a
    texts = [(1, a), (1, a), (1, a.upper()), (2, a), (None, b), (None, b), (None, b.upper()), (3, None), (3, None), (4, c), (5, near)]
    rows = [(d, t, "x", str(i), 0, 0, 0, True, 0) for i, (d, t) in enumerate(texts)]
    kept = nd.drop_near_duplicates(frame(spark, rows), 5).collect()
    assert sorted((repr(r.doc_id), (r.text or "").lower()) for r in kept) == sorted([("1", a), ("None", b), ("3", ""), ("3", ""), ("4", c), ("5", near)])
