"""Language identification by rank-order profiles.

A profile is the list of the ``PROFILE`` most frequent character n-grams (one to three letters, word
boundaries marked) of a language, in order. A text's own list is compared with each: an n-gram
costs the difference of its two places, or ``PROFILE`` if the language's list lacks it; the language
of the least sum wins, ties going to the name that sorts first. The score is one minus the
winner's sum over the worst possible sum.

Profiles are counted over all training texts: tasks sum their n-grams by language, so what is
shuffled is one row per task, language and distinct n-gram, and the top of a language is taken per
hash part first. What is broadcast is ``PROFILE`` n-grams per language, of about ``LANGUAGES``
languages at a time: more of them take more models, through which the texts pass in turn.

Nulls: a null text or one without letters is ``und`` with score 0; rows with a null language are
never learned from. Rows that repeat are learned from and judged one by one. An empty table gives
no rows, and without training rows every text is ``und``. Columns besides doc_id, text and lang
are ignored, whatever their names. A text's n-grams are counted whole, in memory some 60 times its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, map_arrow, slices

PROFILE, ORDERS, LANGUAGES = 400, 3, 2000
UNKNOWN = "und"
#: Characters counted together while learning; parts in which a language's top n-grams are first sought.
SLICE, PARTS = 2 << 20, 64
_BITS = 21  # of a code point
_MARK = 0x5F

_letters: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 where it is none."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out
    return _letters


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of texts, one after another with a boundary before, between and after; the number of the text of each."""
    joined = "\0" + "\0".join(texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold()[raw]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)])
    letter = folded > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each run of letters
    keep[0] = True
    return np.where(letter, folded, _MARK)[keep], owner[keep]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts as numbers, and the text of each; a boundary stands only at an n-gram's ends."""
    codes, owner = _codes(texts)
    mark = codes == _MARK  # no two of them are neighbours
    number, whose = [], []
    for n in range(1, ORDERS + 1):
        size = max(0, len(codes) - n + 1)
        key = np.zeros(size, np.int64)
        good = np.ones(size, bool)
        for k in range(n):
            key = (key << _BITS) | codes[k : k + size]
            if 0 < k < n - 1 or n == 1:
                good &= ~mark[k : k + size]
        number.append(key[good])
        whose.append(owner[np.arange(size) + mark[:size]][good] if n > 1 else owner[good])
    return np.concatenate(number), np.concatenate(whose)


def _ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent keys in order, ties by key."""
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


def profile(text: str) -> np.ndarray:
    keys, counts = np.unique(grams([text])[0], return_counts=True)
    return _ranked(keys, counts)


def is_held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_profiles(training: DataFrame) -> DataFrame:
    """lang, key, place (0 first): the profiles of the languages of ``training`` (text, lang)."""
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
                keys, owner = grams(texts[a:b])
                spoken = which[owner]
                for i, name in enumerate(names):
                    found, n = np.unique(keys[spoken == i], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "key": pa.array(found), "n": pa.array(n)})

    counts = rows.mapInArrow(count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("key").asc()]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(PARTS))).orderBy(*order)
    few = counts.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= PROFILE)
    whole = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return whole.filter(F.col("place") < PROFILE).select("lang", "key", "place")


class Model:
    """Profiles as arrays: the places of each n-gram in the languages whose profiles have it."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        number = {name: i for i, name in enumerate(self.langs)}
        rows = sorted(rows, key=lambda r: r[1])
        self.keys, self.starts = np.unique(np.array([r[1] for r in rows], np.int64), return_index=True)
        self.starts = np.append(self.starts, len(rows))
        self.lang, self.place = np.array([number[r[0]] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text) if text and self.langs else np.empty(0, np.int64)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        mine = np.flatnonzero(self.keys[at] == own)  # what no profile has costs the same in all
        first, size = self.starts[at[mine]], self.starts[at[mine] + 1] - self.starts[at[mine]]
        entry = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        saved = PROFILE - np.abs(self.place[entry] - np.repeat(mine, size))
        cost = PROFILE * len(own) - np.bincount(self.lang[entry], saved, len(self.langs))
        best = int(np.argmin(cost))
        return self.langs[best], float(1 - cost[best] / (PROFILE * len(own)))


def fit(training: DataFrame) -> list[Model]:
    """Models of at most some ``LANGUAGES`` languages each; one, unless there are more of them."""
    scratch = Scratch(training.sparkSession, "profiles")
    profiles = scratch.write(learn_profiles(training), "profiles")
    blocks = -(-profiles.select("lang").distinct().count() // LANGUAGES) or 1
    part = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    models = [Model([tuple(r) for r in profiles.filter(part == b).collect()]) for b in range(blocks)]
    scratch.drop()
    return models


def predict_languages(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text): the best of all models, ties to the name that sorts first."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for model in models:  # texts go from one to the next
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            held = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True)
            best = [f if h[0] == UNKNOWN or f[0] != UNKNOWN and (-f[1], f[0]) < (-h[1], h[0]) else h for f, h in zip(found, held, strict=True)]
            return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "lang_pred": [x[0] for x in best], "score": [x[1] for x in best]}

        last = model is models[-1]
        rows = map_arrow(rows, run, f"doc_id {id_type}, {'' if last else 'text string, '}lang_pred string, score double")
    return rows


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    Scratch(docs.sparkSession, "languages")
    held = is_held_out(F.col("doc_id"))
    models = fit(docs.filter(~held).select("text", "lang"))
    return predict_languages(docs, models).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
