"""Benchmark decontamination, with DataFrame functions only.

The windows of 13 consecutive words of the benchmark items (a shorter item is one window) are a
hash table that is broadcast. Each document's words are hashed once, its windows are hashes of
13 word hashes, and they probe the table inside one generated stage; a hit is verified word by
word, so hash collisions do no harm. Only hits are shuffled, to be gathered per document.

The table is broadcast in blocks of at most ``BLOCK_BYTES`` (measured, not assumed): a larger
benchmark takes more passes over the documents, not more memory.

Nulls: a null text has no words, so it is clean, and a null item gives no windows; null item ids
read ``null``. Documents are told apart by doc_id and text, so rows that repeat get equal results,
and rows that share a doc_id only are judged each by its own text. Empty tables work. A text's words,
hashes and probes are arrays of one row, some 40 bytes a word; its hits are merged into runs in time
proportional to hits times disjoint runs. Columns
besides doc_id, text and item_id are ignored, or kept as they are where rows of the input return.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, drop_rows, packed

WINDOW = 13
#: Word characters before lower-casing A-Z; listed one by one, they are looked up in a bit set.
CASED = r"[0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\x80-\x{10FFFF}]+"
BLOCK_BYTES = 48 << 20
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The place of the probe that stands for the document itself.
SELF = 4_242_424_242_424_242


def words(text: Column) -> Column:
    """Words of a text; null has none. A-Z become a-z, other letters stay as they are."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(CASED), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER_CASE, LOWER_CASE)))


def _hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def _probe(hashes: Column, at: Column, length: int) -> Column:
    """What a window of ``length`` words from ``at`` (0 first) is looked up by: up to four of its words; hits are verified in full."""
    places = sorted({0, length // 3, 2 * length // 3, length - 1})
    return F.xxhash64(F.lit(length), *[F.get(hashes, at + p) for p in places])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """_hash, _length, _words and _items (ids as strings): the distinct windows of all items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("_item"), words(F.col("text")).alias("_all")).filter(F.size("_all") > 0)
    length = F.least(F.size("_all"), F.lit(WINDOW))
    cut = F.transform(F.sequence(F.lit(1), F.size("_all") - length + 1), lambda i: F.slice("_all", i, length))
    windows = items.select("_item", F.explode(cut).alias("_words")).groupBy("_words").agg(F.sort_array(F.collect_set("_item")).alias("_items")).withColumn("_h", _hashes(F.col("_words")))
    key = F.lit(None).cast("bigint")
    for k in range(1, WINDOW + 1):
        key = F.when(F.size("_words") == k, _probe(F.col("_h"), F.lit(0), k)).otherwise(key)
    return windows.select(key.alias("_hash"), F.size("_words").alias("_length"), "_words", "_items")


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, text_key, n_words, _at, _length, _items: every window of a document that the benchmark holds, and a row of length 0 for the document itself."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("_doc_words"))
    base = base.withColumn("_h", _hashes(F.col("_doc_words")))
    n = F.size("_h")
    none = F.array().cast("array<bigint>")

    def cut(length: int) -> Column:
        return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: _probe(F.col("_h"), i, length))).otherwise(none)

    # the windows of all lengths in one array; the index there gives length and place back
    every = F.concat(F.array(F.lit(SELF)), *[cut(k) for k in lengths])
    probes = base.select("doc_id", "text_key", "_doc_words", F.posexplode(every).alias("_index", "_probe"))
    total = F.size("_doc_words")
    place, size, before = F.lit(0), F.lit(0), F.lit(1)
    for k in lengths:
        count = F.greatest(total - k + 1, F.lit(0))
        inside = (F.col("_index") >= before) & (F.col("_index") < before + count)
        place, size, before = F.when(inside, F.col("_index") - before).otherwise(place), F.when(inside, F.lit(k)).otherwise(size), before + count
    same = (F.col("_probe") == F.col("_hash")) & (size == F.col("_length")) & (F.slice("_doc_words", place + 1, size) == F.col("_words"))
    found = probes.join(F.broadcast(windows), same, "inner")
    return found.select("doc_id", "text_key", total.cast("long").alias("n_words"), place.alias("_at"), "_length", "_items")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, spans (disjoint runs of hit words: first word and end), items: one row for each row of ``docs``.

    One pass over the texts. A probe that always hits carries the document itself, so its number
    of words and its hits meet in the same aggregation, and rows that repeat are counted there.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    windows = scratch.write(benchmark_windows(benchmark), "windows")
    size = F.aggregate("_words", F.lit(0), lambda a, w: a + F.octet_length(w) + 16) + F.aggregate("_items", F.lit(0), lambda a, w: a + F.octet_length(w) + 16) + 64
    known = windows.agg(F.sum(size).alias("bytes"), F.collect_set("_length").alias("lengths")).first()  # at most 13 lengths
    blocks, lengths = max(1, -(-(known.bytes or 0) // BLOCK_BYTES)), sorted(known.lengths)
    own = windows.sparkSession.range(1).select(F.lit(SELF).alias("_hash"), F.lit(0).alias("_length"), F.array().cast("array<string>").alias("_words"), F.array().cast("array<string>").alias("_items"))
    found = []
    for b in range(blocks):
        part = windows.filter(F.pmod(F.col("_hash"), F.lit(blocks)) == b) if blocks > 1 else windows
        found.append(_hits(docs, part.unionByName(own) if b == 0 else part, lengths))
    hit = F.col("_length") > 0
    gathered = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(~hit, 1)).cast("int").alias("_rows"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("_at").alias("first"), (F.col("_at") + F.col("_length")).alias("end"))))).alias("_spans"),
        F.collect_set(F.when(hit, F.col("_items"))).alias("_items"),
    )
    merged = F.aggregate(
        "_spans",
        F.array().cast("array<struct<first:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["first"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    rows = gathered.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))))
    return rows.select("doc_id", "text_key", "n_words", merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 5) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items, spans and contaminated (``percent`` of the words are hit, and one at least) of every row."""
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"]).cast("long")
    judged = judge(docs, benchmark).withColumn("n_hit", n_hit)
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return judged.select("doc_id", "text_key", "n_words", "n_hit", "items", "spans", bad.alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    gone = contamination(docs, benchmark, percent).filter("contaminated").select("doc_id", "text_key").distinct()
    return drop_rows(docs, Scratch(docs.sparkSession, "contaminated").write(gone, "gone"))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit words taken out of the texts; what stands between words stays."""
    hits = judge(docs, benchmark).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).distinct()
    both = packed(docs).join(hits, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key")), "left")
    found, gaps = F.regexp_extract_all("row.text", F.lit(CASED), F.lit(0)), F.split("row.text", CASED, -1)
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("_spans", lambda s: F.array(s["first"], s["end"]))))
    last = F.size(gaps)  # the gaps are one more than the words
    # between two edges words stay, or only the gaps do
    piece = lambda e, i: F.zip_with(F.slice(gaps, e + 1, F.get(stops, i) - e), F.slice(F.concat(found, F.array(F.lit(""))), e + 1, F.get(stops, i) - e), lambda gap, word: F.concat(gap, F.when(i % 2 == 0, word).otherwise("")))
    stops = F.concat(F.slice(edges, F.lit(2), F.size(edges)), F.array(last))
    cleaned = F.array_join(F.flatten(F.transform(edges, piece)), "")
    text = F.when(F.col("_spans").isNull(), F.col("row.text")).otherwise(cleaned).alias("text")
    return both.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
