import math
import random
import re

from govlake.llm.quality_rules import BASE, bucket, keep_good, quality_rules

from .helpers import awkward_rows, frame, prose, words


def brute(text):
    w = words(text)
    text = text or ""
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)} if len(w) < 3000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_against_brute_force(spark):
    rows = awkward_rows() + [(900, "a b c d e f g h i " * 3 + "x", "en", "b", 0, 0, 0, True, 0)]
    got = quality_rules(frame(spark, rows)).collect()
    expected = sorted((repr(r[0]), *brute(r[1])) for r in rows)
    assert sorted((repr(r.doc_id), *(r[c] for c in BASE)) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 100), "en", "a", 0, 0, 0, True, 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 100).split()), "en", "a", 0, 0, 0, True, 0) for i in range(20)]
    kept = {r.doc_id for r in keep_good(frame(spark, rows)).collect()}
    assert kept == set(range(300))


def test_word_length_is_judged_by_the_group(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 100), "en", "a", 0, 0, 0, True, 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w * 3 for w in prose(rng, 100).split()), "en", "a", 0, 0, 0, True, 0) for i in range(10)]
    rows += [(2000 + i, " ".join(w[:2] for w in prose(rng, 100).split()), "en", "a", 0, 0, 0, True, 0) for i in range(10)]
    kept = {r.doc_id for r in keep_good(frame(spark, rows)).collect()}
    assert kept == set(range(300))


def test_a_source_full_of_junk_does_not_raise_its_fence(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 100), "en", "a" if i < 300 else "b", 0, 0, 0, True, 0) for i in range(480)]
    rows += [(1000 + i, " ".join(w + "$$" for w in prose(rng, 100).split()), "en", "b", 0, 0, 0, True, 0) for i in range(120)]
    rows += [(2000 + i, " ".join(w + "$$" for w in prose(rng, 100).split()), "xx", "c", 0, 0, 0, True, 0) for i in range(20)]
    kept = {r.doc_id for r in keep_good(frame(spark, rows)).collect()}
    assert kept == set(range(480))


def test_keeps_all_columns_and_clashing_names(spark):
    df = frame(spark, awkward_rows())
    kept = keep_good(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_empty_table(spark):
    assert quality_rules(frame(spark, [])).collect() == []


def test_buckets_are_within_a_sixty_fourth(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 100_000, 7).select("id", bucket(F.col("id")).alias("b")).collect()
    assert all(0 <= r.id - r.b <= r.id / 64 for r in rows)


UNITS = {"m_symbols": (2, 1), "m_dup_lines": (3, 1), "m_repeat": (4, 8)}


def verdicts(rows):
    """kept of every row, by the stated rule alone."""
    facts = [brute(r[1]) for r in rows]

    def value(m, f):
        return f[1] * 1_000_000 // max(f[0], 1) if m == "m_length" else (f[UNITS[m][0]] + UNITS[m][1]) * 1_000_000 // (f[0] + 100)

    def cell(v):
        shift = max(v.bit_length() - 7, 0)
        return v >> shift << shift

    def quartiles(m, some):
        held = sorted(cell(value(m, f)) for f in some)
        return [math.log(held[-(-k * len(held) // 4) - 1]) for k in (1, 2, 3)]

    def shrunk(own, n, wider):
        return [(n * a + 100 * b) / (n + 100) for a, b in zip(own, wider, strict=True)]

    of = lambda test: [f for r, f in zip(rows, facts, strict=True) if f[0] and test(r)]
    every, out = of(lambda r: True), []
    for r, f in zip(rows, facts, strict=True):
        kept = f[0] >= 20 and 100 * f[4] <= 30 * f[0]
        for m, part in (("m_length", 64), ("m_symbols", 4), ("m_dup_lines", 4), ("m_repeat", 4)):
            if kept:
                lang, own = of(lambda x, r=r: x[2] == r[2]), of(lambda x, r=r: x[2:4] == r[2:4])
                q1, q2, q3 = (math.exp(q) for q in shrunk(quartiles(m, own), len(own), shrunk(quartiles(m, lang), len(lang), quartiles(m, every))))
                kept &= value(m, f) <= q2 + 12 * max(q2 - q1, q2 / part)
                kept &= m != "m_length" or value(m, f) >= q2 - 12 * max(q3 - q2, q2 / part)
        out.append(kept)
    return out


def test_fences_and_verdicts_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, None)])
        text = prose(rng, rng.randrange(15, 120)).split()
        if source == "b":
            text = [w * rng.choice([1, 1, 2]) + rng.choice(["", "", "$"]) for w in text]
        for _ in range(rng.choice([0, 0, 0, 1, 4, 30])):
            text.insert(rng.randrange(len(text)), rng.choice(["#", "***", "w" * 60, "\nthe same line\n"]))
        rows.append((i, " ".join(text), lang, source, 0, 0, 0, True, 0))
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()}
    expected = verdicts(rows)
    assert [got[r[0]] for r in rows] == expected and 10 < sum(expected) < 150


def test_sources_with_other_habits_judge_the_same_text_otherwise(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(60, 140)), "en", "prose", 0, 0, 0, True, 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w + rng.choice(["", "$", "|"]) for w in prose(rng, rng.randrange(60, 140)).split()), "en", "code", 0, 0, 0, True, 0) for i in range(300)]
    same = " ".join(w + rng.choice(["", "$", "|"]) for w in prose(rng, 100).split())
    rows += [(5000, same, "en", "prose", 0, 0, 0, True, 0), (5001, same, "en", "code", 0, 0, 0, True, 0)]
    kept = {r.doc_id for r in keep_good(frame(spark, rows)).collect()}
    assert 5001 in kept and 5000 not in kept
    assert sum(i < 1000 for i in kept) > 290 and sum(1000 <= i < 2000 for i in kept) > 290
