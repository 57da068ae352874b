"""Exact removal of long repeated strings with a logarithmic family of sparse suffix arrays.

A string of ``LENGTH`` bytes that starts at two places is covered at both. Instead of all suffixes,
those at *anchors* are indexed: the anchor of a window of ``LENGTH`` bytes is the least hashed 8-gram
among its first ``REACH`` positions, so equal windows have anchors at equal offsets, and the windows
that share an anchor are neighbours. A match of ``LENGTH`` bytes is a match of the
``LENGTH - REACH + 1`` bytes at an anchor, so no more of a suffix is ever compared.

``SuffixFamily`` is a kept index. Each batch of documents gets a sparse suffix array: its suffixes
(equal ones once, with their number) in byte order of their first eight bytes, and where these are
equal in order of a 64-bit fingerprint of the bytes that matter. A new array is merge-scanned
(a merge join of two sorted runs) against every existing level, and suffixes met in both are
written down as matches. The scan of a level of its own order writes the merged run at once, so
levels of equal order become one of the next, and a suffix is rewritten a logarithmic number of times.
An array is dealt over tasks by fingerprint, so a level is many sorted runs side by side, and
equal suffixes always lie in the same one. Later calls open the index again and add to it.

Suffixes without a match are done with: none of their windows repeats. For the others the whole
span of an anchor's windows is fingerprinted. Spans found twice are
covered. Where spans differ though their suffixes agree, one of each kind is cut into blocks of
``BLOCK`` windows and those that still differ into single windows, each step counted the same way. So
only the ends of long matches are ever looked at window by window; everything is counting by key
with partial sums, no group is gathered, no pairs are listed, and the result is exact but for
collisions of 64-bit hashes.

Nulls: a null text is empty, and a null doc_id is kept as it is. Rows that repeat are occurrences of
their own, so equal texts of ``LENGTH`` bytes or more are removed wholly. An empty table gives no rows.
Columns besides doc_id and text are ignored, whatever their names. Very long texts are hashed in
pieces of ``SLICE`` bytes, but a text and the list of its units are one row each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, blobs, free, join_groups, map_arrow

LENGTH, REACH, BLOCK = 400, 200, 20
#: Bytes of text that are hashed together (their arrays fit a core's cache); batches of documents that enter the family one by one.
SLICE, BATCHES = 1 << 18, 4
GRAM = 8
_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            factors = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
            for f in factors:
                f[0] = 1
            cls.up, cls.down = (np.cumprod(f) for f in factors)
        return cls.up, cls.down


class Grams:
    """Hashes of the 8-grams of a buffer, and with prefix sums of all its longer strings."""

    def __init__(self, buffer: bytes):
        n = len(buffer)
        padded = buffer + bytes(2 * GRAM)
        words = np.empty(n, np.uint64)
        for k in range(min(GRAM, n)):
            words[k::GRAM] = np.frombuffer(padded, "<u8", count=len(range(k, n, GRAM)), offset=k)
        self.words = words
        self.each = _mix(words + np.uint64(_BASE))
        up, self.down = _Powers.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.each * up[:n], out=self.sums[1:])

    def heads(self, at: np.ndarray) -> np.ndarray:
        """The 8-grams at ``at`` as numbers whose signed order is byte order."""
        return (self.words[at].byteswap() ^ np.uint64(1 << 63)).view(np.int64)

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of strings of ``size`` >= 8 bytes that begin at ``at``."""
        return _mix((self.sums[at + size - GRAM + 1] - self.sums[at]) * self.down[at])

    def anchors(self) -> np.ndarray:
        """For each position the least 8-gram's among the ``REACH`` positions from there, the first of equals."""
        n = len(self.each)
        keyed = (self.each & ~_POSITION) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // REACH) + 1
        padded = np.full(blocks * REACH, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = keyed
        square = padded.reshape(blocks, REACH)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        return (np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n]) & _POSITION).astype(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Text number, first window, bytes: long texts in pieces whose windows follow one another."""
    for number, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, SLICE):
            yield number, at, text[at : at + SLICE + LENGTH - 1]


def _together(pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for piece in pieces:
        if held and size + len(piece[2]) > SLICE + LENGTH:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


_UNITS = "ck bigint, fk bigint, weight int, text_key bigint, lo int, off int, n int"
_SUFFIXES = f"head bigint, {_UNITS}"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_units(texts: list[bytes], keys: np.ndarray) -> dict:
    """A unit per anchor: head begins its suffix, ck names what its windows share, fk their whole span; windows lo..lo+n-1, anchor at lo+off."""
    out: dict = {c: [] for c in ("head", "ck", "fk", "text_key", "lo", "off", "n")}
    for held in _together(_pieces(texts)):
        sizes = np.array([len(p) for _, _, p in held])
        begin = np.cumsum(sizes) - sizes
        grams = Grams(b"".join(p for _, _, p in held))
        windows = sizes - LENGTH + 1
        at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        anchor = grams.anchors()[at]
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
        first, last = np.concatenate([[0], change + 1]), np.concatenate([change, [len(at) - 1]])
        lo, hi, a = at[first], at[last], anchor[first]
        shared = grams.of(a, LENGTH - REACH + 1)
        span = grams.of(lo, hi - lo + LENGTH)
        which = np.searchsorted(begin, lo, side="right") - 1
        offset = np.array([base for _, base, _ in held])[which] - begin[which]
        out["head"].append(grams.heads(a))
        out["ck"].append(_signed(shared))
        out["fk"].append(_signed(_mix(span ^ _mix(((a - lo) * 1000 + hi - lo).astype(np.uint64) + np.uint64(1)))))
        out["text_key"].append(keys[np.array([number for number, _, _ in held])[which]])
        out["lo"].append((lo + offset).astype(np.int32))
        out["off"].append((a - lo).astype(np.int32))
        out["n"].append((hi - lo + 1).astype(np.int32))
    return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}


_CUT = ("ck", "weight", "lo", "off", "n")


def _cut_units(texts: list[bytes], of: np.ndarray, units: dict[str, np.ndarray], block: int) -> dict:
    """Units of at most ``block`` windows that make up ``units``, and ``row``, the number of the text; aligned to the anchors, so equal windows fall into equal blocks.

    ``of`` is the number of each unit's text. What the units of a text cover is hashed once, about ``SLICE`` bytes together.
    """
    out: dict = {c: [] for c in ("row", "fk", *_CUT)}
    if len(of):
        order = np.lexsort((units["lo"], of))
        of, (ck, weight, lo, off, n) = of[order], (units[c][order].astype(np.int64) for c in _CUT)
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        start = base[of] + lo
        end = start + n - 1 + LENGTH
        before = np.concatenate([start[:1], np.maximum.accumulate(end)[:-1]])
        held = np.cumsum(np.maximum(end - np.maximum(start, before), 0)) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(of)]
    else:
        edges = []
    for i, j in zip(edges, edges[1:], strict=False):
        reach = np.maximum.accumulate(end[i:j])
        opens = np.flatnonzero(np.concatenate([[True], (start[i + 1 : j] > reach[:-1]) | (of[i + 1 : j] != of[i : j - 1])]))
        a, z, which = start[i:j][opens], reach[np.append(opens[1:], j - i) - 1], of[i:j][opens]
        grams = Grams(b"".join(texts[t][x:y] for t, x, y in zip(which.tolist(), (a - base[which]).tolist(), (z - base[which]).tolist(), strict=True)))
        runs = np.repeat(np.cumsum(z - a) - z, np.diff(np.append(opens, j - i)))  # a run begins in the buffer at the bytes before it
        high, count = off[i:j] // block, off[i:j] // block - (off[i:j] - n[i:j] + 1) // block + 1
        k = np.repeat(np.arange(i, j), count)
        near = (np.repeat(high + np.cumsum(count) - count, count) - np.arange(len(k))) * block  # the block's window next to the anchor, whether it is here or not
        first, last = np.maximum(off[k] - near - block + 1, 0), np.minimum(off[k] - near, n[k] - 1)
        begin = (start[i:j] + runs)[k - i]
        shared = grams.of(begin + off[k] - near, LENGTH - block + 1)
        span = grams.of(begin + first, last - first + LENGTH)
        parent = _mix(ck[k].view(np.uint64))
        out["row"].append(of[k])
        out["ck"].append(_signed(_mix(shared ^ (parent + near.astype(np.uint64)))))
        out["fk"].append(_signed(_mix(span ^ _mix(((off[k] - first) * 1000 + last - first).astype(np.uint64) + np.uint64(2)))))
        out["weight"].append(weight[k].astype(np.int32))
        out["lo"].append((lo[k] + first).astype(np.int32))
        out["off"].append((off[k] - first).astype(np.int32))
        out["n"].append((last - first + 1).astype(np.int32))
    return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}


def _flat(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Lists of structs of numbers: the number of each item's list, and the fields' values; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    items = lists.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), {c: items.field(c).to_numpy(zero_copy_only=False) for c in names}


def _suffixes(docs: DataFrame) -> DataFrame:
    """The suffixes at the anchors of all texts."""

    def run(batch: pa.RecordBatch) -> dict:
        made = _anchor_units(blobs(batch.column("text")), batch.column("text_key").to_numpy())
        return made | {"weight": np.ones(len(made["ck"]), np.int32)}

    return map_arrow(docs.filter(F.octet_length("text") >= LENGTH).select(F.xxhash64("text").alias("text_key"), "text"), run, _SUFFIXES)


class SuffixFamily:
    """The index below ``path``: suffixes with their places by batch, levels of sorted runs (head, ck, rows), matches by batch.

    ``state`` says which levels count. A call that fails before it writes a new state leaves the
    old one, and its batch can be added again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.batches, self.made, self.levels = 0, 0, []  # levels: [order, name], the largest first
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._at("state").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(self._at("state")):
            done = [int(s.getPath().getName()) for s in self._fs.listStatus(self._at("state")) if self._fs.exists(self._at(f"state/{s.getPath().getName()}/_SUCCESS"))]
            if done:
                self.batches, self.made, self.levels = json.loads(spark.read.text(f"{path}/state/{max(done)}").first()[0])

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _run(self, run: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        return f"levels/{self.made}", self._write(run.sortWithinPartitions("head", "ck"), f"levels/{self.made}")

    def level(self, name: str) -> DataFrame:
        return self.spark.read.schema("head bigint, ck bigint, rows bigint").parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame) -> None:
        """Index a batch of documents (doc_id, text)."""
        self.enter(self._write(_suffixes(docs), f"units/batch={self.batches}"))

    def enter(self, suffixes: DataFrame) -> None:
        """Array of a batch's suffixes (head, ck), its scans against all levels, and the merges they bring."""
        name, array = self._run(suffixes.groupBy("head", "ck").agg(F.count(F.lit(1)).alias("rows")))
        found, gone, order, carried, levels = [array.filter("rows > 1")], [], 0, array, list(self.levels)
        scan = lambda older, newer, how: newer.withColumnRenamed("rows", "_new").hint("merge").join(older.withColumnRenamed("rows", "_old"), ["head", "ck"], how)
        while levels and levels[-1][0] == order:
            _, old = levels.pop()
            both = scan(self.level(old), carried, "full_outer")
            gone += [old, name]
            name, merged = self._run(both.select("head", "ck", (F.coalesce("_new", F.lit(0)) + F.coalesce("_old", F.lit(0))).alias("rows"), (F.col("_new").isNotNull() & F.col("_old").isNotNull()).alias("met")))
            found.append(merged.filter("met").drop("met"))
            carried, order = merged.drop("met"), order + 1
        for _, old in levels:  # no merge: only the new array is scanned
            found.append(scan(self.level(old), array, "inner").select("head", "ck", (F.col("_new") + F.col("_old")).alias("rows")))
        matches = found[0]
        for more in found[1:]:
            matches = matches.unionByName(more)
        self._write(matches.select("ck", "rows"), f"matches/batch={self.batches}")
        self.levels, self.batches = [*levels, [order, name]], self.batches + 1
        state = json.dumps([self.batches, self.made, self.levels])
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state/{self.batches}")
        for old in gone:
            self._fs.delete(self._at(old), True)
        free(self.spark)

    def repeated(self) -> DataFrame:
        """ck of the suffixes that occur twice or more in all batches, and rows: the most occurrences seen at one match."""
        matches = self.spark.read.schema("ck bigint, rows bigint, batch int").parquet(f"{self.path}/matches")
        return matches.filter(F.col("batch") < self.batches).groupBy("ck").agg(F.max("rows").alias("rows"))

    def units(self) -> DataFrame:
        """The suffixes of all batches with their places."""
        return self.spark.read.schema(f"{_SUFFIXES}, batch int").parquet(f"{self.path}/units").filter(F.col("batch") < self.batches).select("ck", "fk", "weight", "text_key", "lo", "off", "n")


def index_batches(docs: DataFrame, path: str, batches: int = BATCHES) -> SuffixFamily:
    """A new index of ``docs``, which enter in ``batches`` parts; one pass over the texts."""
    family = SuffixFamily(docs.sparkSession, path)
    _suffixes(docs).withColumn("batch", F.pmod(F.col("text_key"), F.lit(batches)).cast("int")).write.option("compression", "zstd").partitionBy("batch").parquet(f"{path}/units")
    every = docs.sparkSession.read.schema(f"{_SUFFIXES}, batch int").parquet(f"{path}/units")
    for b in range(batches):
        family.enter(every.filter(F.col("batch") == b))
    return family


def _refine(scratch: Scratch, units: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Of units whose ck repeats: the spans that are found twice, and one unit of each kind where kinds differ."""
    rep = F.min(F.struct("text_key", "lo", "off", "n")).alias("rep")
    kinds = scratch.write(units.groupBy("ck", "fk").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows"), rep), f"kinds-{level}")
    groups = kinds.groupBy("ck").agg(F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("all"))
    mixed = scratch.write(groups.filter("kinds > 1"), f"mixed-{level}")
    twice = scratch.write(kinds.filter("weight > 1").select("ck", "fk", "rows"), f"twice-{level}")
    covered = join_groups(units.select("ck", "fk", "text_key", "lo", "n"), twice, ["ck", "fk"], "rows").filter(F.col("rows").isNotNull())
    spans = covered.select("text_key", F.col("lo").alias("first"), (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("end")).distinct()
    spans = scratch.write(spans, f"spans-{level}")
    unlike = join_groups(kinds.select("ck", "weight", "rep"), mixed, ["ck"], "kinds").filter(F.col("kinds").isNotNull())
    left = unlike.select("ck", F.least("weight", F.lit(2)).cast("int").alias("weight"), "rep.*")
    return spans, scratch.write(left, f"unlike-{level}")


def _with_texts(docs: DataFrame, lists: DataFrame, texts: DataFrame) -> DataFrame:
    """``lists`` (text_key and more) with the text of each key, once."""
    side = lists.join(texts.select(F.col("text_key").alias("_key"), "rep_id"), F.col("text_key") == F.col("_key")).select(F.col("text_key").alias("_key"), "rep_id", "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.join(side, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("text_key", "text", "items")


def find_repeats(docs: DataFrame, scratch: Scratch, family: SuffixFamily | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of texts (doc_id, text_key, n_bytes, sha256), and spans (text_key, first, end) that cover all repeated bytes.

    ``family`` is the kept index of exactly the documents ``docs``, in any batches; without one an index is made and dropped.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("sha256"))
    known = scratch.write(rows, "documents")
    texts = scratch.write(known.groupBy("text_key").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("rep_id")), "texts")
    index = family or index_batches(docs, scratch.path("family"))
    repeated = scratch.write(index.repeated(), "repeated")
    found = scratch.write(join_groups(index.units(), repeated, ["ck"], "rows").filter(F.col("rows").isNotNull()).drop("rows"), "found")
    if not family:
        scratch.drop("family")

    every, unlike = _refine(scratch, found, 1)
    for level, block in ((2, BLOCK), (3, 1)):
        lists = scratch.write(unlike.groupBy("text_key").agg(F.collect_list(F.struct("ck", "weight", "lo", "off", "n")).alias("items")), f"lists-{level}")

        def cut(batch: pa.RecordBatch, block: int = block) -> dict:
            made = _cut_units(blobs(batch.column("text")), *_flat(batch.column("items"), _CUT), block)
            return made | {"text_key": batch.column("text_key").to_numpy()[made["row"].astype(np.int64)]}

        # a row of the input that repeats gives its units twice; they are told apart by place
        parts = map_arrow(_with_texts(docs, lists, texts), cut, _UNITS).dropDuplicates(["text_key", "lo", "n"])
        smaller = scratch.write(parts, f"units-{level}")
        spans, unlike = _refine(scratch, smaller, level)
        every = every.union(spans)
        free(docs.sparkSession)
    return known, every


def _without(texts: list[bytes], lists: pa.ListArray) -> Iterator[tuple[bytes, int]]:
    """For each text the bytes outside all its spans, and the number of maximal runs taken out."""
    of, spans = _flat(lists, ("first", "end"))
    order = np.lexsort((spans["first"], of))
    of, first, end = of[order], spans["first"][order], spans["end"][order]
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    for text, i, j in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        reach = np.maximum.accumulate(end[i:j])
        opens = np.flatnonzero(first[i + 1 : j] > reach[:-1]) + 1
        starts = [*first[i : i + (j > i)].tolist(), *first[i:j][opens].tolist()]
        ends = [*reach[opens - 1].tolist(), *reach[-1:].tolist()]
        yield b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)), len(starts)


def clean_texts(docs: DataFrame, family: SuffixFamily | None = None) -> DataFrame:
    """doc_id, text_key and kept (bytes: a cut may fall inside a character) of every row."""
    scratch = Scratch(docs.sparkSession, "cleaned")
    known, spans = find_repeats(docs, scratch, family)
    lists = spans.groupBy("text_key").agg(F.collect_list(F.struct("first", "end")).alias("items"))
    rows = known.groupBy("text_key").agg(F.count(F.lit(1)).alias("rows"))
    groups = scratch.write(rows.join(lists, "text_key", "left"), "groups")

    def cut(batch: pa.RecordBatch) -> dict:
        kept = [k for k, _ in _without(blobs(batch.column("text")), batch.column("items"))]
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "kept": kept}

    joined = join_groups(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), groups, ["text_key"], "rows").select("doc_id", "text_key", "text", "items")
    out = scratch.write(map_arrow(joined, cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, kept binary"), "out")
    scratch.drop(*[k for k in scratch.paths if k != "out"])
    return out


def remove_repeats(docs: DataFrame, family: SuffixFamily | None = None) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans (maximal runs) and kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    known, spans = find_repeats(docs, scratch, family)
    texts = docs.sparkSession.read.schema(f"text_key bigint, rows bigint, rep_id {docs.schema['doc_id'].dataType.simpleString()}").parquet(scratch.paths["texts"])
    # equal texts go wholly by rule, so only texts that occur once are cut
    single = texts.filter("rows = 1").select(F.col("text_key").alias("_single"))
    lists = spans.join(single, F.col("text_key") == F.col("_single"), "left_semi").groupBy("text_key").agg(F.collect_list(F.struct("first", "end")).alias("items"))
    lists = scratch.write(lists, "cuts")
    free(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("n_removed", "n_spans", "kept_sha256")}
        texts = blobs(batch.column("text"))
        for text, (kept, runs) in zip(texts, _without(texts, batch.column("items")), strict=True):
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(runs)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out | {"text_key": batch.column("text_key")}

    done = map_arrow(_with_texts(docs, lists, texts), cut, "text_key bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    done = scratch.write(done, "done")
    facts = scratch.write(texts.join(done.select(F.col("text_key").alias("_key"), "n_removed", "n_spans", "kept_sha256"), F.col("text_key") == F.col("_key"), "left").drop("_key", "rep_id"), "facts")
    whole = join_groups(known, facts, ["text_key"], "rows")
    gone = (F.col("rows") > 1) & (F.col("n_bytes") >= LENGTH)
    out = whole.select(
        "doc_id",
        "text_key",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
    out = scratch.write(out, "out")
    scratch.drop(*[k for k in scratch.paths if k != "out"])
    return out
