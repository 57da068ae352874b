"""Quality rules with adaptive thresholds.

One Arrow pass measures every text: mean word length, and the rates of symbols, repeated lines and
repeated words. A rate counts one event and ``PRIOR_WORDS`` words more than the text has, so short
texts have uncertain rates and a measure that is 0 in most texts still has quartiles, which follow
the group's lengths and habits.

Each measure goes into a quantile sketch per language and source: counts by log-linear bucket (64
buckets an octave, so a quantile is within 1/64 of its value). Such sketches merge by adding
counts, which is what the partial and final aggregations do, and those of a language or of the
whole table are sums of those of its sources. The quartiles of a source are shrunk towards those
of its language, and these towards those of the table, by a weight of rows / (rows +
``PRIOR_ROWS``), on a logarithmic scale: no size switches anything.

The fence of a group is its median plus ``SPREAD`` times the distance of its lower quartile. That
holds where up to half of a source is junk: junk raises rates, so it moves the upper quartile
first. Word length also has a fence below, from the upper quartile. No measure has a fixed limit. A source of
which more than half is junk sets a level of its own; the base rules hold there too.

Windows over sketches sort the buckets of one group and measure, a few thousand at most.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups of
their own. Rows that repeat are judged alike, each for itself. An empty table gives no rows.
A text is measured whole in one row, in memory proportional to its length.
Other columns are ignored by ``quality_rules`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlake.llm.common import Scratch, attach, blobs, map_arrow, packed

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Words that a rate adds to a text's own, and rows of its language (or of the table) that a group's quartiles count besides their own.
PRIOR_WORDS, PRIOR_ROWS = 100, 100
SPREAD = 12
#: Values are in millionths: of a word's characters, or of events a word.
SCALE = 1_000_000
#: Least distance of a quartile from the median, as a part of the median: a bucket of the sketch; for rates, a few events where all texts of a group are of one length and have none.
LEAST_DISTANCE = {"m_length": 64, "m_symbols": 4, "m_dup_lines": 4, "m_repeat": 4}
#: The event of each rate: its column, and how much of that column is one event.
EVENTS = {"m_symbols": ("n_symbols", 1), "m_dup_lines": ("n_dup_lines", 1), "m_repeat": ("n_repeat_words", WINDOW)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_START = np.ones(256, np.uint8)
_START[0x80:0xC0] = 0


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    # pairs, fours, eights: each step numbers the distinct windows, so the numbers are exact
    width = 1
    while width < WINDOW:
        both = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids, counts = np.unique(both, return_inverse=True, return_counts=True)[1:]
        width *= 2
    hit = counts[ids] > 1
    if not hit.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # of bytes: splits at \x20 and \x09-\x0D only
    raw = np.frombuffer(text, np.uint8)
    chars = int(_START[raw[~_IS_SPACE[raw]]].sum(dtype=np.int64)) if words else 0
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            seen.add(line)
    dup = lines - len(seen)
    return len(words), chars, int(_IS_SYMBOL[raw].sum()), dup, repeated_words(words)


def _base(batch: pa.RecordBatch) -> dict:
    names = batch.schema.names
    texts = batch.column("text") if "text" in names else batch.column("row").field("text")
    rows = [measures(t) for t in blobs(texts)]
    return dict(zip(BASE, map(list, zip(*rows, strict=True)), strict=True)) | {c: batch.column(c) for c in names if c != "text"}


def bucket(v: Column) -> Column:
    """Log-linear bucket of a non-negative integer: its lower bound, with 7 leading bits kept."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return v - v % step


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, rows and the logarithms of the quartiles q1, q2, q3 of one level of groups, from its bucket counts."""
    by = Window.partitionBy(*keys, "measure")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = sketch.withColumn("_upto", F.sum("n").over(upto)).withColumn("_n", F.sum("n").over(by))
    at = lambda q: F.log(F.min(F.when(4 * F.col("_upto") >= q * F.col("_n"), F.col("bucket"))))
    return total.groupBy(*keys, "measure").agg(F.max("_n").alias("rows"), *[at(q).alias(f"q{q}") for q in (1, 2, 3)])


def thresholds(base: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, rows and the fences that hold for that group."""
    measures_ = list(LEAST_DISTANCE)
    stacked = base.filter("n_words > 0").select("lang", "source", F.explode(F.create_map(*[x for m in measures_ for x in (F.lit(m), F.col(m))])).alias("measure", "value"))
    sketch = scratch.write(stacked.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "sketch")
    merged = lambda *keys: sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))

    def shrunk(groups: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
        """``groups`` with quartiles that count ``PRIOR_ROWS`` rows of the wider group's besides their own."""
        side = wider.select(*[F.col(c).alias(f"_{c}") for c in (*on, "q1", "q2", "q3")])
        same = F.col("measure") == F.col("_measure")
        for k in on[:-1]:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        blend = lambda q: ((F.col("rows") * F.col(q) + PRIOR_ROWS * F.col(f"_{q}")) / (F.col("rows") + PRIOR_ROWS)).alias(q)
        return groups.join(side, same).select(*[c for c in groups.columns if c not in ("q1", "q2", "q3")], blend("q1"), blend("q2"), blend("q3"))

    lang = shrunk(_quartiles(merged("lang"), ["lang"]), _quartiles(merged(), []), ["measure"])
    own = shrunk(_quartiles(sketch, ["lang", "source"]), lang, ["lang", "measure"])
    part = F.element_at(F.create_map(*[x for m, d in LEAST_DISTANCE.items() for x in (F.lit(m), F.lit(1.0 / d))]), F.col("measure"))
    q1, q2, q3 = (F.exp(q) for q in ("q1", "q2", "q3"))
    fenced = own.withColumn("high", q2 + SPREAD * F.greatest(q2 - q1, q2 * part)).withColumn("low", q2 - SPREAD * F.greatest(q3 - q2, q2 * part))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    fences = fenced.groupBy("lang", "source").agg(F.max("rows").alias("rows"), *[pick(m, "high") for m in measures_], pick("m_length", "low"))
    return scratch.write(fences, "thresholds")


def _judged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Base measures, base_failed and kept of rows with lang, source and a text, which may stand in a packed ``row``; all other columns come along."""
    carried = T.StructType([f for f in rows.schema if f.name != "text"])
    base = map_arrow(rows, _base, T.StructType([*carried, *[T.StructField(c, T.LongType()) for c in BASE]]))
    rate = lambda c, unit: (F.col(c) + unit) * SCALE / (F.col("n_words") + PRIOR_WORDS)
    scaled = {"m_length": F.col("word_chars") * SCALE / F.greatest(F.col("n_words"), F.lit(1)), **{m: rate(c, unit) for m, (c, unit) in EVENTS.items()}}
    base = scratch.write(base.withColumns({m: F.floor(v).cast("long") for m, v in scaled.items()}), "base")
    judged = attach(base, thresholds(base, scratch), ["lang", "source"], "rows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = F.col("m_length") >= F.col("low_m_length")
    for m in LEAST_DISTANCE:
        good &= F.col(m) <= F.col(f"high_{m}")
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(good, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), lang, source, the five base measures, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source)."""
    scratch = Scratch(docs.sparkSession, "rules")
    judged = _judged(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "lang", "source", "text"), scratch)
    out = scratch.write(judged.select("doc_id", "text_key", "lang", "source", *BASE, "base_failed", "kept"), "judged")
    scratch.drop(*[k for k in scratch.paths if k != "judged"])
    return out


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; rows are written beside their measures once, and no text is shuffled."""
    rows = packed(docs).select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    return _judged(rows, Scratch(docs.sparkSession, "good")).filter("kept").select("row.*")
