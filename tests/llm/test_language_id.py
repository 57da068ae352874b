import random
import zlib
from collections import Counter

from govlake.llm import language_id as li

from .helpers import awkward_rows, frame


def brute_grams(text):
    out, word = Counter(), ""
    for ch in text + " ":
        low = ch.lower() if len(ch.lower()) == 1 else ch
        if ch.isalpha():
            word += low
            continue
        padded = f"_{word}_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if word and g != "_":
                    out[g] += 1
        word = ""
    return out


def number(gram):
    out = 0
    for ch in gram:
        out = out << 21 | ord(ch)
    return out


def test_grams_against_brute_force():
    texts = ["Äh, Ñandú  a  b\ncd9e", "", "a", "  x", "word", "123", "日本 語", "İx"]
    keys, owner = li.grams(texts)
    for i, t in enumerate(texts):
        expected = Counter({number(g): n for g, n in brute_grams(t).items()})
        assert Counter(keys[owner == i].tolist()) == expected, t


def corpus(n=300):
    rng = random.Random(1)
    stems = {"aa": "lor ip dol sum".split(), "bb": "kras tov nyi shch".split(), "cc": "ão ç lh nh é".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(stems))
        text = " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60)))
        rows.append((i, text, lang if rng.random() < 0.9 else None, "s", 0, 0, 0, True, 0, lang))
    return rows


def test_held_out_accuracy_and_no_peeking(spark):
    rows = corpus()
    got = {r.doc_id: r for r in li.identify(frame(spark, [r[:9] for r in rows])).collect()}
    truth = {r[0]: r[9] for r in rows}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    wrong = [(r[0], r[1], "zz" if got[r[0]].held_out else r[2], *r[3:9]) for r in rows]  # what is held out has no say
    assert {r.doc_id: r.lang_pred for r in li.identify(frame(spark, wrong)).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_profiles_against_brute_force(spark):
    rows = corpus(80)
    training = frame(spark, [r[:9] for r in rows]).select("text", "lang")
    counts = {}
    for r in rows:
        if r[2]:
            counts.setdefault(r[2], Counter()).update({number(g): n for g, n in brute_grams(r[1]).items()})
    expected = {(lang, k, i) for lang, c in counts.items() for i, (k, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: li.PROFILE])}
    assert {tuple(r) for r in li.learn_profiles(training).collect()} == expected


def test_awkward_rows_and_no_training(spark):
    rows = awkward_rows()
    got = li.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and not any(c.isalpha() for c in rows[r.doc_id][1] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    none = [(*r[:2], None, *r[3:]) for r in rows]
    assert {r.lang_pred for r in li.identify(frame(spark, none)).collect()} == {"und"}
    assert li.identify(frame(spark, [])).collect() == []


def test_winner_and_score_against_brute_force(spark, monkeypatch):
    rows = [r[:9] for r in corpus(120)] + [(900, "zz 12 9", "aa", "s", 0, 0, 0, True, 0), (901, "q", None, "s", 0, 0, 0, True, 0), (902, "lor ão kras ip ç tov", None, "s", 0, 0, 0, True, 0)]

    def ranked(c):
        return [g for g, _ in sorted(((number(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))[: li.PROFILE]]

    counts = {}
    for r in rows:
        if r[2] and zlib.crc32(str(r[0]).encode()) % 5:
            counts.setdefault(r[2], Counter()).update(brute_grams(r[1]))
    known = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in counts.items()}
    expected = {}
    for r in rows:
        own = ranked(brute_grams(r[1]))
        far = {lang: sum(abs(place[g] - i) if g in place else li.PROFILE for i, g in enumerate(own)) for lang, place in known.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        expected[r[0]] = (best, round(1 - far[best] / (li.PROFILE * len(own)), 9))
    for most in (li.LANGUAGES, 1):  # in one model, and in several that texts pass in turn
        monkeypatch.setattr(li, "LANGUAGES", most)
        assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in li.identify(frame(spark, rows)).collect()} == expected
