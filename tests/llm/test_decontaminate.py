import random
import re

import pytest
from pyspark.sql import functions as F

from govlake.llm import decontaminate as dc

from .helpers import awkward_rows, frame, prose

BENCHMARK = "item_id bigint, text string, doc_id int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for item, text, _ in items:
            b = words(text)
            k = min(13, len(b))
            windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add("null" if item is None else str(item))
        out.append((r[0], len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def build(seed=1):
    rng = random.Random(seed)
    items = [(i, prose(rng, n), 0) for i, n in enumerate([13, 14, 20, 40, 5, 1, 12])]
    items += [(10, items[2][1], 0), (2, items[2][1], 0), (11, None, 0), (12, "", 0), (None, prose(rng, 15), 0), (13, "  ...  ", 0)]
    rows = awkward_rows()
    texts = []
    for i in range(40):
        parts = prose(rng, rng.randrange(5, 400)).split()
        for item, text, _ in rng.sample(items, 2):
            if text:
                piece = text.split()
                cut = rng.choice([0, 0, 1, 3])
                piece = piece[cut:] if rng.random() < 0.5 else piece[: len(piece) - cut]
                at = rng.randrange(len(parts))
                parts[at:at] = ["(" + piece[0].upper() + ")", *piece[1:]] if piece and piece[0].isascii() else piece
        texts.append((100 + i, " ".join(parts), "en", "s", 0, 0, 0, True, 0))
    return rows + texts, items


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 3000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rows, items = build()
    got = dc.contamination(frame(spark, rows), spark.createDataFrame(items, BENCHMARK)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == brute(rows, items)


def test_spans_and_documents_are_removed(spark):
    rows, items = build(2)
    df, bench = frame(spark, rows), spark.createDataFrame(items, BENCHMARK)
    kept = dc.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in brute(rows, items) if not x[4]), key=repr)
    cleaned = dc.remove_spans(df, bench)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    left = sorted(((r.doc_id, len(words(r.text))) for r in cleaned.collect()), key=repr)
    assert left == sorted(((d, n - h) for d, n, h, _, _ in brute(rows, items)), key=repr)
    same = cleaned.filter(F.col("doc_id") == 4).first()
    assert same.text == rows[4][1] or words(same.text) != words(rows[4][1])


def test_empty_tables(spark):
    rows, items = build(3)
    bench = spark.createDataFrame(items, BENCHMARK)
    assert dc.contamination(frame(spark, []), bench).collect() == []
    assert {r.n_hit for r in dc.contamination(frame(spark, rows), bench.limit(0)).collect()} == {0}


def test_main_path_is_native(spark):
    rows, items = build(3)
    df = dc.contamination(frame(spark, rows), spark.createDataFrame(items, BENCHMARK))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_spans_go_whatever_the_columns_are_called(spark):
    rng = random.Random(11)
    piece = prose(rng, 16)
    texts = [f"{piece}", f"a, b {piece}! c", f"x {piece} y\n{piece}.", "nothing here", None, ""]
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], "doc_id bigint, text string, _spans string, _key string")
    cleaned = dc.remove_spans(df, spark.createDataFrame([(1, piece, 0)], BENCHMARK))
    assert cleaned.columns == df.columns
    gaps = " " * 15
    assert [r.text for r in cleaned.orderBy("doc_id").collect()] == [gaps, f"a, b {gaps}! c", f"x {gaps} y\n{gaps}.", "nothing here", None, ""]
