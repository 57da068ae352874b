import hashlib
import random
from collections import Counter

import pytest

from govlake.llm import suffix_family as sf

from .helpers import awkward_rows, frame, prose


def brute(rows):
    counts = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        counts.update(t[i : i + sf.LENGTH] for i in range(len(t) - sf.LENGTH + 1))
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - sf.LENGTH + 1):
            if counts[t[i : i + sf.LENGTH]] > 1:
                gone[i : i + sf.LENGTH] = b"\1" * sf.LENGTH
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def build(seed):
    """Passages of lengths around the limit, in documents of their own words; near copies; runs."""
    rng = random.Random(seed)
    shared = [prose(rng, n)[: sf.LENGTH + d] for n, d in ((90, -1), (90, 0), (90, 1), (90, 37), (400, 1500), (120, 205), (120, 199))]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(5, 120)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 60)
            parts.insert(rng.randrange(4), s[cut:] if rng.random() < 0.4 else s)
        texts.append(rng.choice(["", " ", "é"]).join(parts))
    base = prose(rng, 700)
    for _ in range(12):  # near copies: single words changed
        words = base.split()
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    texts += ["ab" * 300, "x" * 399, "x" * 400, "x" * 401, "y" * 400, base, base, "z" * 1000]
    rows = [(i, t, None, None, 0, 0, 0, True, 0) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, texts[9], None, None, 0, 0, 0, True, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = build(seed)
    expected = brute(rows)
    got = sorted((tuple(r) for r in sf.remove_repeats(frame(spark, rows)).drop("text_key").collect()), key=repr)
    assert got == [x[:5] for x in expected]
    assert sorted((repr(r.doc_id), bytes(r.kept)) for r in sf.clean_texts(frame(spark, rows)).collect()) == sorted((repr(x[0]), x[5]) for x in expected)


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = sorted((tuple(r) for r in sf.remove_repeats(frame(spark, rows)).drop("text_key").collect()), key=repr)
    assert got == [x[:5] for x in brute(rows)]


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sf, "SLICE", 997)
    rng = random.Random(5)
    body = prose(rng, 900)
    texts = [(prose(rng, 50 + i) + body + prose(rng, 30)).encode() for i in range(3)]
    import numpy as np

    units = sf._anchor_units(texts, np.array([1, 2, 3]))
    seen = Counter()
    for key, lo, n in zip(units["text_key"], units["lo"], units["n"], strict=True):
        seen.update((int(key), int(i)) for i in range(lo, lo + n))
    assert seen == Counter((k + 1, i) for k, t in enumerate(texts) for i in range(len(t) - sf.LENGTH + 1))


def test_texts_are_hashed_once_when_their_units_are_cut(spark, monkeypatch):
    """Units of a text overlap by nearly 400 bytes each; what they cover is hashed once, many texts together, whatever the slices."""
    import numpy as np

    rng = random.Random(6)
    texts = [prose(rng, 300 + 40 * i).encode() for i in range(20)] + [b"", b"x" * 400]
    texts.append(texts[3])
    units = sf._anchor_units(texts, np.arange(len(texts)))
    units["weight"] = np.ones(len(units["ck"]), np.int32)
    hashed = []
    plain = sf.Grams.__init__
    monkeypatch.setattr(sf.Grams, "__init__", lambda self, buffer: (hashed.append(len(buffer)), plain(self, buffer))[1])
    shuffled = np.random.default_rng(1).permutation(len(units["ck"]))
    mixed = {c: v[shuffled] for c, v in units.items()}
    shown = lambda made: sorted(zip(*(made[c].tolist() for c in ("row", "lo", "n", "off", "ck", "fk", "weight")), strict=True))
    for block in (sf.BLOCK, 1):
        hashed.clear()
        made = shown(sf._cut_units(texts, mixed["text_key"], mixed, block))
        assert sum(hashed) <= sum(map(len, texts)) and len(hashed) == 1
        assert Counter((r, i) for r, lo, n, *_ in made for i in range(lo, lo + n)) == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t) - sf.LENGTH + 1))
        assert max(n for _, _, n, *_ in made) <= block
        assert [x[1:] for x in made if x[0] == 3] == [x[1:] for x in made if x[0] == 22]  # equal texts, equal units
        with monkeypatch.context() as m:
            m.setattr(sf, "SLICE", 997)
            assert shown(sf._cut_units(texts, mixed["text_key"], mixed, block)) == made


def test_levels_grow_geometrically(spark, tmp_path):
    orders = []
    for _ in range(5):
        family = sf.SuffixFamily(spark, f"file://{tmp_path}/index")  # each batch in a call of its own
        family.enter(spark.range(10).selectExpr("id as head", "id as ck"))
        orders.append([o for o, _ in family.levels])
    assert orders == [[0], [1], [1, 0], [2], [2, 0]]
    assert family.repeated().count() == 10
    assert sum(r.rows for _, name in family.levels for r in family.level(name).collect()) == 50


def test_batches_of_separate_calls_give_the_rows_of_one_call(spark, tmp_path):
    rows = build(3)
    for b in range(3):
        sf.SuffixFamily(spark, f"file://{tmp_path}/index").add(frame(spark, rows[b::3]))
    family = sf.SuffixFamily(spark, f"file://{tmp_path}/index")
    assert family.batches == 3 and [o for o, _ in family.levels] == [1, 0]
    got = sorted((tuple(r) for r in sf.remove_repeats(frame(spark, rows), family).drop("text_key").collect()), key=repr)
    assert got == [x[:5] for x in brute(rows)]
    family.add(frame(spark, []))  # an empty batch changes nothing
    again = sf.SuffixFamily(spark, f"file://{tmp_path}/index")
    assert again.batches == 4 and again.repeated().count() == family.repeated().count() > 0


def test_levels_are_in_byte_order(spark, tmp_path):
    import pyarrow.parquet as pq

    texts = [prose(random.Random(i), 900) for i in range(4)]
    family = sf.SuffixFamily(spark, f"file://{tmp_path}/index")
    family.add(frame(spark, [(i, t, None, None, 0, 0, 0, True, 0) for i, t in enumerate(texts)]))
    heads = {t.encode()[i : i + 8] for t in texts for i in range(len(t.encode()) - 7)}
    files = list((tmp_path / "index" / family.levels[0][1]).glob("*.parquet"))
    shown = [[(h + (1 << 63)).to_bytes(8, "big") for h in pq.read_table(f)["head"].to_pylist()] for f in files]
    assert sum(map(len, shown)) > 50 and all(run == sorted(run) and heads.issuperset(run) for run in shown)


def test_empty_table(spark):
    assert sf.remove_repeats(frame(spark, [])).collect() == []
