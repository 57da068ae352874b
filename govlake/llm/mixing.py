"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's target over its
size. The documents of a source stand in order of size, their expected copies are prefix-summed,
one random offset (from a seeded digest of the source's name) is added, and a copy is emitted for
each integer boundary that a document's interval crosses. The order by size makes neighbours
interchangeable, so the words taken stay within about one document of the target.

Nulls: a null text has no words; a null source is a source of its own, the last; a null doc_id is
kept as it is. Rows that repeat are documents of their own. An empty table gives no rows. Other
columns are ignored by ``mix_sources`` and kept by ``mix_rows``, whatever their names. Texts of
any length count as their number of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.common import FEW_BYTES, Scratch, attach, measured_bytes, packed, running_totals, word_count

OFFSET_BITS = 32


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, n_docs (a written table, one row per source) -> plus weight and target.

    Targets are ``level`` times the weight, ``cap`` times the size at most. Each round of water-filling
    sums the sources over and under the present level, until no more are capped: aggregations only,
    as sources may be as many as hosts. For the same reason few of them only are ranked in one task.
    """
    if measured_bytes(sizes) <= FEW_BYTES:
        ranked = sizes.withColumn("before", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    else:
        ranked = running_totals(scratch, sizes.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "_one", name="ranked").drop("_one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    known = scratch.write(ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap))).drop("before"), "weights")
    level, capped = 0.0, -1
    over = lambda at: F.col("_cap") < F.lit(at) * F.col("weight")
    while True:
        some = over(level)
        sums = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(some, F.col("_cap")).otherwise(0.0)).alias("full"), F.sum(F.when(some, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(some).alias("n")).first()
        if sums.n == capped or not sums.free:
            break
        level, capped = ((sums["all"] * share - sums.full) / sums.free), sums.n
    target = F.when(over(level), F.col("_cap")).otherwise(F.lit(level) * F.col("weight"))
    return known.withColumn("target", target).select("source", "source_size", "n_docs", "weight", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document.

    ``weights`` repeat over the sources in code point order (null last); the targets sum to
    ``share`` of all words and stop at ``cap`` times their source's.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(docs.select("doc_id", "source", word_count("text").alias("size"), F.lit(1).cast("long").alias("_one")), "sized")
    sizes = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sizes")
    targets = scratch.write(source_targets(scratch, sizes, weights, share, cap), "targets")
    ranked = running_totals(scratch, sized, [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc()], "_one", "source")
    named = F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(named), 1, OFFSET_BITS // 4), 16, 10).cast("double") / F.lit(float(2**OFFSET_BITS))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mixed = attach(ranked, targets, ["source"], "n_docs").withColumn("_expected", expected).withColumn("_offset", offset)
    part = F.col("_expected") - F.floor("_expected")
    crossed = F.floor((F.col("before") + 1) * part + F.col("_offset")) - F.floor(F.col("before") * part + F.col("_offset"))
    mixed = mixed.withColumn("copies", (F.floor("_expected") + crossed).cast("long"))
    out = scratch.write(mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), "mixed")
    scratch.drop(*[k for k in scratch.paths if k != "mixed"])
    return out


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as the mix takes it."""
    taken = mix_sources(docs, weights, share, cap, seed)
    copies = taken.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    mine = copies.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_copies", "_rows")
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_source")) & (word_count("row.text") == F.col("_size"))
    # rows that share doc_id, source and size share their copies evenly, as all rows of the source do
    row = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("row.text")))
    joined = packed(docs).join(mine.hint("merge"), same)  # a row per document: never one to broadcast
    several = joined.filter("_rows > 1").withColumn("_n", F.floor((F.col("_copies") + row - 1) / F.col("_rows")).cast("int"))
    single = joined.filter("_rows = 1").withColumn("_n", F.col("_copies").cast("int"))
    return single.unionByName(several).select("row", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select("row.*")
