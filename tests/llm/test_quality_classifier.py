import random

import numpy as np

from govlake.llm import quality_classifier as qc

from .helpers import awkward_rows, frame, prose

LABELS = "doc_id bigint, quality int, toxic int"


def rated(n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = rng.random()
        words = prose(rng, rng.randrange(20, 200)).split()
        quality, toxic = 1, 0
        if kind < 0.15:
            toxic = 1
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["vilex", "brutnak,", "Snorg"])
        elif kind < 0.35:
            quality, words = 0, [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", "s", 0, 0, 0, True, 0))
        labels.append((i, quality, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = rated()
    got = {r.doc_id: r for r in qc.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [x for x in labels if got[x[0]].held_out]
    toxic, poor, good = ([i for i, q, t in held if (t, q) == x] for x in ((1, 1), (0, 0), (0, 1)))
    assert np.mean([not got[i].kept for i in toxic]) >= 0.9 and np.mean([not got[i].kept for i in poor]) >= 0.95
    assert np.mean([got[i].kept for i in good]) >= 0.98
    grades = [np.mean([got[i].expected_grade for i in x]) for x in (toxic, poor, good)]
    assert grades == sorted(grades)


def test_thresholds_are_ordered_and_the_fit_is_bounded(spark):
    rows, labels = rated(200)
    model = qc.fit_grades(frame(spark, rows), spark.createDataFrame(labels, LABELS), most=50)
    assert list(model.thresholds) == sorted(model.thresholds)
    chances = model.at_least(np.array([-5.0, 0.0, 5.0]))
    assert (chances[:, 0] >= chances[:, 1]).all() and (np.diff(chances[:, 0]) >= 0).all()


def test_held_out_ratings_have_no_say(spark):
    rows, labels = rated(300)
    a = qc.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    held = {r.doc_id for r in a if r.held_out}
    other = [(i, 1 - q, 1 - t) if i in held else (i, q, t) for i, q, t in labels]
    b = qc.classify(frame(spark, rows), spark.createDataFrame(other, LABELS)).collect()
    assert {(r.doc_id, r.p_good) for r in a} == {(r.doc_id, r.p_good) for r in b}


def test_awkward_rows_and_no_ratings(spark):
    rows = awkward_rows()
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 1), (None, 1, 1), (2, 0, 1)], LABELS)
    for some in (labels, labels.limit(0)):
        got = qc.classify(frame(spark, rows), some).collect()
        assert len(got) == len(rows)
        assert all(not r.kept for r in got if r.doc_id is not None and not (rows[r.doc_id][1] or "").split())
    assert qc.classify(frame(spark, []), labels).collect() == []


def test_fit_and_scores_against_brute_force(spark):
    """The fitted point is the least of the penalised likelihood, written out; scores follow from it."""
    import math

    rng = random.Random(4)
    texts, grades = [], []
    for _ in range(240):
        grade = rng.choice([0, 1, 2, 2])
        texts.append(np.array(sorted({rng.randrange(3) + 3 * grade if rng.random() < 0.7 else rng.randrange(9) for _ in range(3)}), np.int32))
        grades.append(grade)
    model = qc.OrdinalModel.fit(texts, np.array(grades))

    def loss(weights, thresholds):
        total = qc.SHRINK * sum(w * w for w in weights) / 2
        for t, g in zip(texts, grades, strict=True):
            below = [0.0, *[1 / (1 + math.exp(-(c - sum(weights[k] for k in t)))) for c in thresholds], 1.0]
            total -= math.log(below[g + 1] - below[g]) / len(texts)
        return total

    weights, thresholds = [float(w) for w in model.weights[:9]], [float(c) for c in model.thresholds]
    assert not model.weights[9:].any() and np.count_nonzero(model.weights[:9]) >= 6
    found = loss(weights, thresholds)
    learned = [i for i in range(9) if weights[i]]  # the others were screened out
    for i in [*learned, "a", "b"]:
        for step in (-0.1, 0.1):
            w, c = list(weights), list(thresholds)
            if i == "a" or i == "b":
                c["ab".index(i)] += step
            else:
                w[i] += step
            assert loss(w, c) > found - 1e-5, i

    rows = [(i, t, "en", "s", 0, 0, 0, True, 0) for i, t in enumerate(["alpha beta", "beta, GAMMA beta", "", None, "delta"])]
    made = qc.OrdinalModel(np.random.default_rng(5).normal(size=qc.DIMENSIONS).astype(np.float32), np.array([-0.5, 0.7]))
    for r in qc.score_documents(frame(spark, rows), made).collect():
        score = sum(float(made.weights[k]) for k in qc.features((rows[r.doc_id][1] or "").encode()))
        chances = [1 / (1 + math.exp(-(score - c))) for c in (-0.5, 0.7)]
        assert math.isclose(r.p_good, chances[1], rel_tol=1e-5) and math.isclose(r.expected_grade, sum(chances), rel_tol=1e-5)
        assert r.kept == (chances[1] >= 0.3 and bool((rows[r.doc_id][1] or "").split()))
