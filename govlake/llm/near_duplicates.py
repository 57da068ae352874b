"""Near-duplicates by HyperMinHash.

1. One Arrow pass turns each text into its set of hashed shingles, a digest of that set, and a
   HyperMinHash sketch: the hash's top bits choose one of 256 registers, which keeps the smallest
   hash as leading-zero count (6 bits) and mantissa (10 bits). Sets themselves are not kept.
2. Documents with equal sets form a class; only classes go on, so copies cost one row each.
3. ``BANDS`` bands of ``BAND`` registers (empty ones borrow another's by a fixed random order) are
   hashed to buckets. Two sets of similarity 0.8 miss every bucket with a chance of 2e-9.
4. Candidates are tested by size, then by the collision-corrected similarity estimate of the
   sketches (rejecting only beyond five standard errors), then on their full sets, which are
   made again from the texts of the few classes involved.
5. A class of whose shingles more than a fifth occur in no other candidate class cannot have a
   link. Counting shingles among the candidates sieves such classes out without a single pair.
6. Within a bucket no pairs are listed while one link can do: in rounds, each class tests one
   partner in another component (first the bucket's most central class), and verified links
   merge components.
7. Classes that still share a bucket across components are sieved again. Of two linked sets the
   rarest shingles (as many as the smaller overlap allows to miss, and one) must meet; so
   pairs between components are listed only where such prefixes do, outside the largest
   component that holds the shingle, and tested as before. No link between components is
   lost. Classes of one component never list each other; classes of several components do, where
   they share a shingle that is among the rarest of both and their sizes allow a link.

The result has the exact connected components of all links among candidates.

Nulls: a null or blank text has no shingles and is linked with nothing; fewer words than a shingle
make one shingle of the whole sequence. A null doc_id counts after all others, so a component has a
null id only where all its rows have. Rows that repeat are in one class. Rows sharing a doc_id are
told apart by text. An empty table gives no rows. Columns besides doc_id and text are ignored, or
kept as they are by ``drop_near_duplicates``. A text's set of shingles is one row, 8 bytes a shingle.

``kept`` says that a row bears its component's id; where ids repeat, several rows of one component
do. ``drop_near_duplicates`` keeps one row of each component all the same: of its smallest doc_id
that whose text has the smallest hash, and of rows that repeat that one any. Texts without words
are linked with nothing, so all of them stay.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.common import FEW_BYTES, Scratch, attach, blobs, drop_rows, join_groups, keep_rows, map_arrow, measured_bytes
from govlake.llm.components import connected

REGISTER_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << REGISTER_BITS
EMPTY = 0xFFFF
BAND, BANDS = 5, 50
#: Standard deviations below the threshold at which an estimate rejects a pair.
DOUBT = 5.0
#: Pairs a node from which sketches and sets of few bytes are broadcast to the pairs.
MET_OFTEN = 8
#: Rounds of one test per class before the pairs that are left are listed.
ROUNDS = 2
CACHED_WORDS = 150_000

_rng = np.random.default_rng(7)
_ORDER = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1)  # where an empty register looks
_ODD = [int(x) | 1 for x in _rng.integers(0, 2**63, 64)]
_BAND_KEYS = _rng.integers(1, 2**63, (BANDS, BAND), dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ``text`` in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z only, and \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        whole = xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))
        return _mix(np.array([whole], np.uint64))
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    out = each[:n].copy()
    for k in range(1, shingle):
        out = out * np.uint64(_ODD[k]) + each[k : k + n]
    return np.unique(_mix(out))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of hashes."""
    registers = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        place = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))  # sorted: a register's first is its smallest
        rest = (hashes[first] & np.uint64((1 << (64 - REGISTER_BITS)) - 1)).astype(np.float64)
        mantissa, exponent = np.frexp(np.maximum(rest, 1.0))
        zeros = np.clip(64 - REGISTER_BITS - exponent, 0, 62)
        registers[place[first]] = (zeros << MANTISSA_BITS) | ((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    return registers


def bands(registers: np.ndarray) -> np.ndarray:
    """Bucket keys of a sketch that is not empty."""
    full = registers != EMPTY
    if not full.all():  # only empty registers borrow, so a sketch without any has keys of the same kind
        registers = np.where(full, registers, registers[_ORDER[np.arange(REGISTERS), np.argmax(full[_ORDER], axis=1)]])
    cells = registers[: BAND * BANDS].reshape(BANDS, BAND).astype(np.uint64) + np.uint64(1)
    return _mix((_mix(cells) * _BAND_KEYS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of sketches (rows), less the collisions of registers that chance gives, and its standard error if ``similarity`` is the true one.

    A register in use holds one element of the union, so small unions are sampled almost whole, and the error shrinks accordingly.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = np.maximum(size_a, size_b) / np.maximum(1, np.minimum(size_a, size_b))
    chance = 0.169919487159739 * 2.0 ** (REGISTER_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    used = np.maximum(used, 1)
    union = np.maximum((size_a + size_b) / (1 + similarity), used)
    error = np.sqrt(similarity * (1 - similarity) / used * np.maximum(1 - used / union, 0.1))
    return np.maximum(same - chance, 0) / used, error + 1 / (DOUBT * used)


def _describe(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"n": [], "set_key": [], "registers": []}
        for text in blobs(batch.column("text")):
            hashes = shingle_set(text, shingle)
            out["n"].append(len(hashes))
            out["set_key"].append(hashlib.sha256(hashes.tobytes()).digest()[:16] if len(hashes) else None)
            out["registers"].append(sketch(hashes).tobytes() if len(hashes) else None)
        return out | {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key")}

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n bigint, set_key binary, registers binary")


class _Verifier:
    """Tests pairs of classes (a, b) on sizes, sketches and full sets."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int):
        self.scratch, self.percent = scratch, percent
        self.sieved = 0
        self.sketches = nodes.select("node", "n", "registers")
        keys = nodes.select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key"))
        if measured_bytes(nodes.select("node", "rep")) <= FEW_BYTES:
            keys = F.broadcast(keys)
        rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        texts = rows.join(keys, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")

        def run(batch: pa.RecordBatch) -> dict:
            return {"node": batch.column("node"), "hashes": [shingle_set(t, shingle).tobytes() for t in blobs(batch.column("text"))]}

        self.sets = scratch.write(map_arrow(texts, run, "node bigint, hashes binary"), "sets")
        if self.sets.count() > nodes.count():  # rows of the input that repeat: any one of them serves
            self.sets = scratch.write(self.sets.dropDuplicates(["node"]), "sets")

    def _spread(self, some: DataFrame) -> DataFrame:
        """node, shingle of every set."""

        def run(batch: pa.RecordBatch) -> dict:
            raw = batch.column("hashes").to_pylist()
            return {"shingle": np.frombuffer(b"".join(raw), np.int64), "node": np.repeat(batch.column("node").to_numpy(), [len(r) // 8 for r in raw])}

        return map_arrow(some, run, "shingle bigint, node bigint")

    def prefixes(self, nodes: DataFrame) -> DataFrame:
        """bucket (a shingle), node, place, n: the rarest shingles of each node, of which a link needs one in common.

        A shingle's place counts those of its node that are rarer; ones that no other node has come first.
        """
        some = self.sets.join(nodes, "node", "left_semi")
        spread = self.scratch.write(self._spread(some), "spread")
        held = self.scratch.write(spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "held")
        common = join_groups(spread, held, ["shingle"], "k").filter("k > 1")
        by = Window.partitionBy("node")
        sized = common.join(some.select("node", (F.octet_length("hashes") / 8).cast("long").alias("n")), "node")
        placed = sized.withColumn("place", F.col("n") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("k", "shingle")) - 1)
        needed = F.ceil(F.lit(self.percent) * F.col("n") / 100)
        out = self.scratch.write(placed.filter(F.col("place") <= F.col("n") - needed).select(F.col("shingle").alias("bucket"), "node", "place", "n"), "prefixes")
        self.scratch.drop("spread", "held")
        return out

    def sieve(self, nodes: DataFrame) -> DataFrame:
        """Of ``nodes`` those that may have a link among themselves: enough of their shingles occur in two or more."""
        some = self.sets.join(nodes, "node", "left_semi")
        held = self._spread(some).groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node"))
        alone = held.filter("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        sized = some.select("node", (F.octet_length("hashes") / 8).cast("long").alias("n")).join(alone, "node", "left")
        self.sieved += 1
        return self.scratch.write(sized.filter(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= self.percent * F.col("n")).select("node"), f"sieved-{self.sieved}")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b) those whose sets are similar enough.

        Sketches come before full sets, in two joins, so that full sets move for probable pairs only.
        Where counts show that each node is met many times and that the sets of all nodes concerned
        are small, they are broadcast to the pairs instead, and one pass does both.
        """
        least = self.percent / 100

        def side(df: DataFrame, c: str) -> DataFrame:
            return df.select(*[F.col(x).alias(f"{x}_{c}") for x in df.columns])

        def likely(batch: pa.RecordBatch) -> np.ndarray:
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            matrix = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b")]
            found, error = estimates(*matrix, *sizes, least)
            return (found + DOUBT * error >= least) & (np.minimum(*sizes) >= least * np.maximum(*sizes) - 1e-6)

        def equal(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= self_percent * (len(x) + len(y) - common))
            return batch.filter(pa.array(keep, pa.bool_()))

        self_percent = self.percent
        ends = lambda batch: {c: batch.column(c) for c in ("a", "b")}
        concerned = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        described = self.scratch.write(self.sketches.join(concerned, "node", "left_semi"), "described")
        sets = self.sets.join(described.select("node"), "node", "left_semi")
        nodes = described.count()
        often = pairs.count() >= MET_OFTEN * nodes
        if often and (sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) + nodes * (2 * REGISTERS + 64) <= FEW_BYTES:
            whole = self.scratch.write(described.join(sets, "node"), "whole")
            both = pairs.join(F.broadcast(side(whole, "a")), F.col("a") == F.col("node_a")).join(F.broadcast(side(whole, "b")), F.col("b") == F.col("node_b"))
            rows = both.select("a", "b", "n_a", "n_b", "registers_a", "registers_b", "hashes_a", "hashes_b")
            return map_arrow(rows, lambda batch: ends(equal(batch.filter(pa.array(likely(batch))))), "a bigint, b bigint")
        both = pairs.join(side(described, "a"), F.col("a") == F.col("node_a")).join(side(described, "b"), F.col("b") == F.col("node_b"))
        rows = both.select("a", "b", "n_a", "n_b", "registers_a", "registers_b")
        probable = map_arrow(rows, lambda batch: ends(batch.filter(pa.array(likely(batch)))), "a bigint, b bigint")
        full = probable.join(side(sets, "a"), F.col("a") == F.col("node_a")).join(side(sets, "b"), F.col("b") == F.col("node_b"))
        return map_arrow(full.select("a", "b", "hashes_a", "hashes_b"), lambda batch: ends(equal(batch)), "a bigint, b bigint")


def _merge(scratch: Scratch, comps: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """node, comp after the components that ``links`` connect have become one."""
    linked = scratch.write(links, f"links{tag}")
    if not linked.limit(1).count():
        return comps
    left = linked.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
    both = left.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    labels = connected(scratch, both.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    sized = scratch.write(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")).join(labels.withColumnRenamed("node", "comp"), "comp", "left"), f"labels{tag}")
    return scratch.write(attach(comps, sized, ["comp"], "rows").select("node", F.coalesce("label", "comp").alias("comp")), f"comps{tag}")


def _mixed(scratch: Scratch, known: DataFrame, tag: str) -> tuple[DataFrame, DataFrame] | None:
    """Of ``known`` (bucket, node, comp and more) the buckets with several components, and their rows; None if there are none."""
    sizes = known.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.groupBy("bucket").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    mixed = scratch.write(stats.filter("parts > 1"), f"mixed-{tag}")
    if not mixed.limit(1).count():
        return None
    return mixed, scratch.write(attach(known, mixed, ["bucket"], "rows").filter(F.col("rows").isNotNull()), f"mine-{tag}")


def _components(scratch: Scratch, members: DataFrame, verifier: _Verifier) -> DataFrame:
    """node, comp for the nodes of ``members`` (bucket, node, rows: the bucket's number of members)."""
    every = scratch.write(members.groupBy("node").agg(F.sum("rows").alias("central")), "every")
    able = verifier.sieve(every.select("node"))
    members = scratch.write(members.select("bucket", "node").join(able, "node", "left_semi"), "able")
    comps = scratch.write(every.select("node", F.col("node").alias("comp")), "comps-0")
    for turn in range(ROUNDS):
        # one test per class: with the bucket's most central class, then with one of chance in its largest component
        if (found := _mixed(scratch, members.join(comps, "node"), str(turn))) is None:
            return comps
        mixed, mine = found
        choice = mine.join(every, "node").withColumn("order", -F.col("central")) if turn == 0 else mine.filter("comp = largest").withColumn("order", F.xxhash64(F.col("node"), F.lit(turn)))
        centres = choice.groupBy("bucket").agg(F.min(F.struct("order", "node", "comp")).alias("centre"))
        centred = scratch.write(centres.join(mixed.select("bucket", "rows"), "bucket"), f"centres-{turn}")
        tests = attach(mine.select("bucket", "node", "comp"), centred, ["bucket"], "rows").filter(F.col("centre.comp") != F.col("comp"))
        chosen = tests.groupBy("node").agg(F.min("centre").alias("centre")).select(F.col("node").alias("a"), F.col("centre.node").alias("b"))
        comps = _merge(scratch, comps, verifier.links(scratch.write(chosen, f"tests-{turn}")), f"-{turn + 1}")
    if (found := _mixed(scratch, members.join(comps, "node"), "rest")) is None:
        return comps
    prefixes = verifier.prefixes(verifier.sieve(found[1].select("node").distinct()))
    for turn in range(ROUNDS + 1):
        if (found := _mixed(scratch, prefixes.join(comps, "node"), f"prefix-{turn}")) is None:
            return comps
        if turn < ROUNDS:  # one more test per class, with a class of another component that holds its rarest common shingle
            centres = found[1].groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.col("node"), F.lit(turn)).alias("order"), "node", "comp")).alias("centre"))
            centred = scratch.write(centres.join(found[0].select("bucket", "rows"), "bucket"), f"near-centres-{turn}")
            tests = attach(found[1].select("bucket", "node", "comp"), centred, ["bucket"], "rows").filter(F.col("centre.comp") != F.col("comp"))
            chosen = tests.groupBy("node").agg(F.min(F.struct("rows", "centre")).alias("best")).select(F.col("node").alias("a"), F.col("best.centre.node").alias("b"))
            comps = _merge(scratch, comps, verifier.links(scratch.write(chosen, f"near-tests-{turn}")), f"-near-{turn}")
    mine = found[1]
    side = lambda c: [F.col("node").alias(c), F.col("comp").alias(f"c{c}"), F.col("place").alias(f"p{c}"), F.col("n").alias(f"n{c}")]
    small, others = mine.filter("comp <> largest").select("bucket", *side("a")), mine.select("bucket", "largest", *side("b"))
    whole = 100 + verifier.percent  # sets of n_a and n_b shingles that are linked share percent / whole of both together
    needed = F.floor((F.lit(verifier.percent) * (F.col("na") + F.col("nb")) + (whole - 1)) / whole)
    near = (100 * F.least("na", "nb") >= verifier.percent * F.greatest("na", "nb")) & (F.col("pa") <= F.col("na") - needed) & (F.col("pb") <= F.col("nb") - needed)
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("largest")) | (F.col("a") < F.col("b")))
    pairs = small.join(others, (small["bucket"] == others["bucket"]) & near & once)
    unique = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    return _merge(scratch, comps, verifier.links(unique), "-last")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (smallest doc_id reachable), kept and first (the text that stands for the component) of every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.write(_describe(docs, shingle), "rows")
    some = rows.filter("n > 0")
    classes = some.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def keys(batch: pa.RecordBatch) -> dict:
        found = [bands(np.frombuffer(r, np.uint16)) for r in batch.column("registers").to_pylist()]
        flat = np.concatenate(found)
        return {"bucket": flat, "node": np.repeat(batch.column("node").to_numpy(), BANDS)}

    buckets = map_arrow(classes.select("node", "registers"), keys, "bucket bigint, node bigint")
    shared = scratch.write(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "shared")
    members = scratch.write(join_groups(buckets, shared, ["bucket"], "rows").filter("rows > 1").select("bucket", "node", "rows"), "members")
    nodes = scratch.write(classes.join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    comps = _components(scratch, members, _Verifier(scratch, nodes, docs, shingle, percent))

    least = scratch.write(nodes.select("node", "rep").join(comps, "node").groupBy("comp").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("rows")), "least")
    placed = attach(comps, least, ["comp"], "rows").select("node", "first")
    final = classes.join(placed, "node", "left").select("set_key", "rows", F.coalesce("first", "rep").alias("first"))
    final = scratch.write(final.select("set_key", "rows", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key")), "final")
    whole = join_groups(some.select("doc_id", "text_key", "n", "set_key"), final, ["set_key"], "rows").select("doc_id", "text_key", "n", "component_id", "first_key")
    whole = whole.union(rows.filter("n = 0").select("doc_id", "text_key", "n", "doc_id", "text_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = scratch.write(whole.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), (kept & (F.col("text_key") == F.col("first_key"))).alias("first")), "out")
    scratch.drop(*[k for k in scratch.paths if k != "out"])
    return out


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns."""
    rows, scratch = near_duplicates(docs, shingle, percent), Scratch(docs.sparkSession, "dropped")
    pairs = rows.filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.bool_and("first").alias("first"), F.count(F.lit(1)).alias("n"))
    gone = scratch.write(pairs.filter("n > 1 OR NOT first"), "gone")
    others = drop_rows(docs, gone)
    again = gone.filter("first")  # rows that repeat: any one of them stays
    return others.unionByName(keep_rows(docs, again).dropDuplicates(["doc_id", "text"])) if again.limit(1).count() else others
