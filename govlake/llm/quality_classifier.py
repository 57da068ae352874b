"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed words is shared by all grades; ordered thresholds cut its score into
grades: P(grade <= k) = sigmoid(threshold_k - score). A text's expected grade and the probability
of reaching a given grade select it. Ratings become grades here: 0 toxic, 1 poor, 2 good.

The model is fitted on at most ``FIT_ROWS`` rated rows (a documented bound), those of least hashed
doc_id among the rows that are not held out. Their feature numbers come to the driver, the
weights (``DIMENSIONS`` floats) go out by broadcast; every row is scored from its whole text.

Nulls: a null or blank text has no features; it gets the score 0 and is not kept. Rows with a null
rating are not learned from; several ratings of a doc_id count as its worst. Rows that repeat are
scored alike. An empty table gives no rows; without ratings the scores are null and all texts
with words are kept. Columns besides doc_id, text, quality and toxic are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, blobs, map_arrow

DIMENSIONS, FIT_ROWS = 1 << 18, 20_000
#: Training texts that a feature needs, and standard errors by which its grades must differ from the mean; steps, step size and shrinkage of the fit.
LEAST_TEXTS, LEAST_ERRORS = 4, 4.0
STEPS, STEP, SHRINK = 200, 0.08, 1e-4
GRADES = 3
CACHED_WORDS = 300_000
_EDGES = b".,;:!?\"'()[]{}<>#*$%&|-_/\\"


class _Features(dict):
    """Feature numbers of a token: its word, and the marks around it."""

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        word = token.strip(_EDGES)
        names = [b"w:" + word] if word else []
        if word != token:
            at = token.find(word) if word else 0
            names.append(b"m:" + token[:at] + b"~" + token[at + len(word) :])
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[token] = tuple(xxhash.xxh32_intdigest(n) % DIMENSIONS for n in names)
        return found


_features = _Features()


def features(text: bytes) -> np.ndarray:
    """Distinct feature numbers of a text in UTF-8: words, marks around words, shares of capitals and of distinct words."""
    cased = text.split()
    if not cased:
        return np.empty(0, np.int32)
    tokens, n = set(text.lower().split()), len(cased)
    capitals = sum(1 for w in cased if w[:2].isupper() and len(w) > 1)
    found = {k for t in map(_features.__getitem__, tokens) for k in t}
    for name in (b"c:%d" % (10 * capitals // n), b"r:%d:%d" % (10 * len(tokens) // n, n.bit_length() // 2)):
        found.add(xxhash.xxh32_intdigest(name) % DIMENSIONS)
    return np.fromiter(found, np.int32, len(found))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class OrdinalModel:
    """Weights and ordered thresholds; ``fit`` takes the features of texts and their grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, numbers: np.ndarray) -> float:
        return float(self.weights[numbers].sum())

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, texts: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
        sizes = np.array([len(t) for t in texts])
        flat, row = np.concatenate(texts) if len(texts) else np.empty(0, np.int32), np.repeat(np.arange(len(texts)), sizes)
        # words that chance alone spreads over the grades so would only be learned by heart
        held = np.bincount(flat, minlength=DIMENSIONS)
        told = np.zeros(DIMENSIONS, bool)
        for k in range(1, GRADES):
            p = np.mean(grades >= k).clip(1e-3, 1 - 1e-3) if len(grades) else 0.5
            above = np.bincount(flat, (grades[row] >= k).astype(float), minlength=DIMENSIONS)
            told |= np.abs(above - held * p) >= LEAST_ERRORS * np.sqrt(held * p * (1 - p))
        told &= held >= LEAST_TEXTS
        flat, row = flat[told[flat]], row[told[flat]]
        share = np.array([np.mean(grades >= k) for k in range(1, GRADES)]).clip(1e-3, 1 - 1e-3)
        first = -np.log(share / (1 - share))
        gap = np.log(np.maximum(np.diff(first), 1e-2))
        # Adam on weights, first threshold and log gaps, so the thresholds stay in order
        values = np.concatenate([np.zeros(DIMENSIONS), first[:1], gap])
        mean, square = np.zeros_like(values), np.zeros_like(values)
        n, index = max(1, len(texts)), np.arange(len(texts))
        for step in range(1, STEPS + 1):
            weights, thresholds = values[:DIMENSIONS], np.cumsum(np.concatenate([values[DIMENSIONS : DIMENSIONS + 1], np.exp(values[DIMENSIONS + 1 :])]))
            scores = np.bincount(row, weights[flat], minlength=len(texts))
            below = np.column_stack([np.zeros(len(texts)), _sigmoid(thresholds[None, :] - scores[:, None]), np.ones(len(texts))])
            slope = below * (1 - below)
            lower, upper = index * 0 + grades, index * 0 + grades + 1
            chance = np.maximum(below[index, upper] - below[index, lower], 1e-9)
            by_score = (slope[index, upper] - slope[index, lower]) / chance / n  # of the negative log-likelihood
            by_threshold = np.array([(np.where(lower == k, slope[:, k], 0) - np.where(upper == k, slope[:, k], 0)) @ (1 / chance) / n for k in range(1, GRADES)])
            tail = np.cumsum(by_threshold[::-1])[::-1]
            slopes = np.concatenate([np.bincount(flat, by_score[row], minlength=DIMENSIONS) + SHRINK * weights, tail[:1], tail[1:] * np.exp(values[DIMENSIONS + 1 :])])
            mean, square = 0.9 * mean + 0.1 * slopes, 0.99 * square + 0.01 * slopes**2
            values -= STEP * (1 - 0.9 * step / STEPS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(values[:DIMENSIONS].astype(np.float32), np.cumsum(np.concatenate([values[DIMENSIONS : DIMENSIONS + 1], np.exp(values[DIMENSIONS + 1 :])])))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 0).when(quality <= 0, 1).otherwise(2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_grades(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> OrdinalModel | None:
    """Fit on at most ``most`` rated rows of ``docs``; None if there are none."""
    rated = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rated = rated.groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "grade")

    def run(batch: pa.RecordBatch) -> dict:
        return {"grade": batch.column("grade"), "features": [features(t).tobytes() for t in blobs(batch.column("text"))], "key": batch.column("key")}

    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    listed = map_arrow(rows.select("grade", "text", F.xxhash64("doc_id").alias("key")), run, "grade int, features binary, key bigint")
    table = listed.orderBy("key", "features").limit(most).toArrow()  # doc_ids of many rows must not pass the bound
    if not table.num_rows:
        return None
    texts = [np.frombuffer(f, np.int32) for f in table.column("features").to_pylist()]
    return OrdinalModel.fit(texts, table.column("grade").to_numpy().astype(np.int64))


def score_documents(docs: DataFrame, model: OrdinalModel | None, least_grade: int = 2, least_chance: float = 0.3) -> DataFrame:
    """doc_id, expected_grade, p_good (the chance of ``least_grade`` or more) and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m, numbers = shared.value, [features(t) for t in blobs(batch.column("text"))]
        words = np.array([len(x) > 0 for x in numbers], bool)
        if m is None:
            return {"doc_id": batch.column("doc_id"), "expected_grade": [None] * len(numbers), "p_good": [None] * len(numbers), "kept": words}
        chances = m.at_least(np.array([m.score(x) for x in numbers]))
        good = chances[:, least_grade - 1]
        return {"doc_id": batch.column("doc_id"), "expected_grade": chances.sum(axis=1), "p_good": good, "kept": words & (good >= least_chance)}

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_good double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, p_good and kept of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality, toxic)."""
    Scratch(docs.sparkSession, "classifier")
    model = fit_grades(docs, labels)
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_good", "kept")
