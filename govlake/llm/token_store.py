"""Token ids in a content-addressed store.

Every document becomes a stream of ids with an end id. A rolling hash over the ids cuts the
stream into chunks, so equal passages give equal chunks wherever they stand. The store holds

* ``kind=1``: the unique chunks (SHA-256 digest, little-endian ids of ``width`` bytes),
* ``recipes``: a row per document in ascending doc_id order: its first id's place in the whole
  stream, its number of ids, the digests of its chunks with their ends, and a Merkle root,
* ``manifest``: for every 2**20 ids of the stream a digest over its documents' roots.

Reading back checks each chunk against its digest, each recipe against its root and the roots
against the manifest. Checksums of documents are joined from those of their chunks (CRC-32 of a
concatenation is linear), so no document is gathered in one place unless its ids are asked for.

Nulls: a null text is empty and has the end id only; a null doc_id comes first. Rows that repeat
are documents of their own, with places of their own. An empty table gives an empty store.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlake.llm.common import Scratch, free, join_groups, map_arrow, running_totals

#: Ids a chunk: at least, at most; the rolling hash looks at ``SPAN`` ids and cuts once in 2**CUT_BITS.
LEAST, MOST, SPAN, CUT_BITS = 128, 4096, 16, 9
SEGMENT_BITS = 20
#: Words encoded in one call, characters of texts taken together.
TOGETHER, SLICE = 200, 8 << 20
#: Words whose ids a worker remembers, some 40 bytes each; beyond that it starts again.
KNOWN_WORDS = 1_000_000
SEEN_DIGESTS = 200_000

_rng = np.random.default_rng(20_240_101)
_GEAR = _rng.integers(0, 2**63, 1 << 16, dtype=np.uint64)

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_PUNCTUATION = ".,;:!?"
_LATIN_END = "\u0250"
#: White space besides the space and the line feed; texts with any go the slower way.
_RARE_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _plain_spaces(text: str) -> bool:
    """Spaces stand between two characters that are not white space, line feeds at most in pairs."""
    if not text or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[0] == " " or text[-1] == " " or text.endswith("\n\n"):
        return False
    return not any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE_ASCII + _RARE))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _gather(pool: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions in ``pool`` of runs that begin at ``at``, one after another; short numbers where they do, as there is one for each id."""
    total = int(sizes.sum())
    short = np.int32 if max(len(pool), total) < 1 << 31 else np.int64
    out = np.repeat((at - _starts(sizes)).astype(short), sizes)
    out += np.arange(total, dtype=short)
    return out


class Encoder:
    """The tokenizer of a file's content; ids are bytes of ``dtype``.

    A byte-level pre-tokenizer always starts a new word at a single space between two other
    characters, at a line feed and after it, and at a punctuation mark that follows a letter. So a
    slice of texts is cut there, each distinct word that the last slices did not have is encoded
    (many in one call, line feeds between), and the ids are gathered. Texts with other white space are cut at their safe
    spaces only. Texts that hold an added token, and all texts of other kinds of tokenizers, go whole.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.dtype = "<u2" if small else "<u4"
        made = json.loads(content)
        pre = made.get("pre_tokenizer") or {}
        single = {c: self.ids(c) for c in "\n" + _PUNCTUATION}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made.get("normalizer") and all(len(x) == 1 for x in single.values())
        self.marks = {c: x[0] for c, x in single.items() if x}
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.known, self.sizes, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype=self.dtype).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        free = [self.by_piece and not any(x in t for x in self.added) for t in texts]
        plain = [ok and _plain_spaces(t) for t, ok in zip(texts, free, strict=True)]
        fast = iter(self._plain([t for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(fast) if p else self._odd(t) if ok else self.whole(t) for t, ok, p in zip(texts, free, plain, strict=True)]

    def _odd(self, text: str) -> bytes:
        parts = _BETWEEN.split(text)
        return self.whole(parts[0]) + b"".join([self.whole(" " + p) for p in parts[1:]])

    def _plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        first = lists.offsets.to_numpy()[:-1]
        coded = lists.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary
        heads = pieces.take(pa.array(codes[first])).dictionary_encode()  # without a space before: encoded by themselves
        alone = [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(heads.dictionary.to_pylist(), add_special_tokens=False)]

        # a piece is a line feed (or not), a word, a punctuation mark (or not)
        line = pc.starts_with(pieces, "\n")
        body = pc.if_else(line, pc.utf8_slice_codeunits(pieces, 1), pieces)
        last, before = pc.utf8_slice_codeunits(body, -1), pc.utf8_slice_codeunits(body, -2, -1)
        marked = pc.and_(pc.is_in(last, pa.array(list(_PUNCTUATION), pa.large_string())), pc.and_(pc.utf8_is_alpha(before), pc.less(before, _LATIN_END)))
        word = pc.if_else(marked, pc.utf8_slice_codeunits(body, 0, -1), body)
        named = pc.if_else(line, pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\n", word, "")]), word).dictionary_encode()
        which = named.indices.to_numpy()
        sizes, places, pool = self._words(named.dictionary)

        line, marked = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (line, marked))
        own = sizes[which]
        lengths = line + own + marked
        start = _starts(lengths)
        ids = np.empty(int(lengths.sum()), self.dtype)
        ids[start[line > 0]] = self.marks["\n"]
        ids[_gather(ids, start + line, own)] = pool[_gather(pool, places[which], own)]
        at = np.flatnonzero(marked)
        ids[start[at] + lengths[at] - 1] = [self.marks[c] for c in last.take(pa.array(at)).to_pylist()]

        each = lengths[codes]
        each[first] = 0
        stream = ids[_gather(ids, start[codes], each)]
        bounds = [*_starts(each)[first].tolist(), len(stream)]
        return [alone[h] + stream[a:b].tobytes() for h, a, b in zip(heads.indices.to_pylist(), bounds, bounds[1:])]  # noqa: B905

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of ids of words, where they begin, and the ids of all known words; what earlier slices had is looked up."""
        found = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = found < 0
        if fresh.any():
            new = words.filter(pa.array(fresh))
            sizes, pool = self._encode(new.to_pylist())
            if len(self.known) + len(new) > KNOWN_WORDS:  # start again, with this slice's words
                old = found[~fresh]
                ids = _gather(self.pool, _starts(self.sizes)[old], self.sizes[old])
                self.known, self.sizes, self.pool = self.known.take(pa.array(old)), self.sizes[old], self.pool[ids]
                found[~fresh] = np.arange(len(old))
            found[fresh] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, pool])
        return self.sizes[found], _starts(self.sizes)[found], self.pool

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of distinct words, and their ids; a word after a line feed begins with it, others follow a space."""
        sizes = np.zeros(len(words), np.int64)
        kinds = [i for i, w in enumerate(words) if w and w[0] != "\n"], [i for i, w in enumerate(words) if w[:1] == "\n" and len(w) > 1]
        calls = []
        for kind, (before, skip) in zip(kinds, ((" ", 0), ("", 1)), strict=True):
            calls += ["\n".join([before + words[k][skip:] for k in kind[i : i + TOGETHER]]) for i in range(0, len(kind), TOGETHER)]
        feed = self.marks.get("\n", -1)
        stream = np.array([x for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False) for x in (*e.ids, feed)], dtype=self.dtype)
        ends, order = stream == feed, [*kinds[0], *kinds[1]]
        at, pool = np.flatnonzero(ends), stream[~ends]
        if len(at) != len(order):
            raise ValueError("the tokenizer joins line feeds with other text")
        in_order = np.diff(at, prepend=-1) - 1
        sizes[order] = in_order
        places = np.zeros(len(words), np.int64)
        places[order] = _starts(in_order)
        return sizes, pool[_gather(pool, places, sizes)]


_encoders: dict[str, Encoder] = {}


def _encoder(content: str) -> Encoder:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last ``SPAN`` ids would cut, in ascending order."""
    rolled, span = _GEAR[ids & 0xFFFF], 1
    while span < SPAN:  # each step doubles the ids that a hash has seen
        longer = rolled.copy()
        longer[span:] += rolled[:-span] << np.uint64(span)
        rolled, span = longer, 2 * span
    return np.flatnonzero((rolled >> np.uint64(SPAN + 8)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    ends, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST and m < n:
            ends.append(m)
            last = m
    if last < n:
        ends.append(n)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of ids, by a rolling hash of the last ``SPAN`` ids."""
    return _ends(_marks(ids).tolist(), len(ids)) if len(ids) > LEAST else [len(ids)]


def merkle(digests: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


_ROWS = "kind int, key binary, doc_id {id}, n_tokens bigint, root binary, digests array<binary>, ends array<bigint>, data binary"


def _cut_documents(docs: DataFrame, content: str, end_id: int, width_type: str) -> DataFrame:
    """A recipe row per document, and a chunk row per digest and task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    typed = T._parse_datatype_string(_ROWS.format(id=docs.schema["doc_id"].dataType.simpleString()))
    shared = docs.sparkSession.sparkContext.broadcast(content)
    end = np.array([end_id], dtype=width_type).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, encoder, seen = to_arrow_schema(typed), _encoder(shared.value), set()
        pid, number = TaskContext.get().partitionId(), 0
        for ids, texts in _together(batches):
            rows, size = [], 0
            for doc_id, raw in zip(ids, encoder.encode_all(texts), strict=True):
                raw += end
                stream = np.frombuffer(raw, dtype=width_type)
                ends, wide, digests, last = cuts(stream), stream.itemsize, [], 0
                for e in ends:
                    data = raw[last * wide : e * wide]
                    digests.append(digest := hashlib.sha256(data).digest())
                    if digest not in seen:
                        if len(seen) >= SEEN_DIGESTS:
                            seen.clear()
                        seen.add(digest)
                        rows.append((1, digest, None, None, None, None, None, data))
                        size += len(data)
                    last = e
                rows.append((0, struct.pack("<qq", pid, number), doc_id, ends[-1], merkle(digests), digests, ends, None))
                number += 1
                if size > 4 << 20:
                    yield _batch(rows, out)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, out)

    return docs.select("doc_id", "text").mapInArrow(run, typed)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of ``SLICE`` characters at least, whatever batches they come in; one text alone may be longer."""
    ids, texts, size = [], [], 0
    for batch in batches:
        more = [t or "" for t in batch.column("text").to_pylist()]
        ids += batch.column("doc_id").to_pylist()
        texts += more
        size += sum(map(len, more))
        if size >= SLICE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _batch(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)


@dataclass
class TokenStore:
    """Where a store lies. ``recipes``, ``chunks`` and ``manifest`` read its files."""

    spark: SparkSession
    path: str
    id_type: str
    width: int

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.schema(f"key binary, data binary, n_tokens bigint, doc_id {self.id_type}, kind int").parquet(f"{self.path}/streams").filter("kind = 1").select("key", "data")

    @property
    def recipes(self) -> DataFrame:
        return self.spark.read.schema(f"doc_id {self.id_type}, start bigint, n_tokens bigint, root binary, digests array<binary>, ends array<bigint>").parquet(f"{self.path}/recipes")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.schema("segment bigint, documents bigint, ids bigint, digest string").parquet(f"{self.path}/manifest")


def _segments(recipes: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("root").alias("root")))), lambda x: x["root"]), "\n")
    return recipes.groupBy(F.shiftright("start", SEGMENT_BITS).alias("segment")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"), F.sha2(listed, 256).alias("digest"))


def write_store(docs: DataFrame, tokenizer_file: str, end_id: int = 0, path: str | None = None) -> TokenStore:
    """Encode ``docs`` (doc_id, text) and write a store below ``path`` (by default in the shared folder)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = path or scratch.path("store")
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's; executors get its content
        content = f.read()
    width_type = Encoder(content).dtype
    store = TokenStore(spark, path, docs.schema["doc_id"].dataType.simpleString(), int(width_type[2]))
    rows = _cut_documents(docs, content, end_id, width_type)
    # one shuffle: the keys of recipes are their own, chunks of equal digest meet, and a sort of each partition finds them
    rows.repartition("key").dropDuplicates(["key"]).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/streams")
    free(spark)
    streams = spark.read.schema(T.StructType([f for f in rows.schema if f.name != "data"])).parquet(f"{path}/streams").filter("kind = 0")
    flat = streams.select("doc_id", "n_tokens", "root", "digests", "ends")
    placed = running_totals(scratch, flat, [F.col("doc_id").asc_nulls_first(), F.col("root").asc()], "n_tokens")
    placed.select("doc_id", F.col("before").alias("start"), "n_tokens", "root", "digests", "ends").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _segments(store.recipes).write.parquet(f"{path}/manifest")
    scratch.drop(*[k for k in scratch.paths if k != "store"])
    return store


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2), modulo that of CRC-32, bits reflected."""
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def _squares() -> list[np.ndarray]:
    """x to the powers of two."""
    powers = [np.array([1 << 30], np.uint32)]
    while len(powers) < 32:
        powers.append(_multiply(powers[-1], powers[-1]))
    return powers


def moved_crc(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """What each piece's CRC-32 adds to that of a stream in which so many 32-bit ids follow it."""
    squares = _squares()
    out = crc.astype(np.uint32)
    for bit in range(int(ids_after.max(initial=0)).bit_length()):
        chosen = np.flatnonzero(ids_after >> bit & 1)
        if len(chosen):  # a 32-bit id is 2**5 bits
            out[chosen] = _multiply(np.broadcast_to(squares[(bit + 5) % 32], len(chosen)), out[chosen])
    return out


def _references(store: TokenStore) -> DataFrame:
    """A row per chunk of each document, after the recipe has been checked against its root."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("start", "ordinal", "key", "n", "after")}
        for start, total, root, digests, ends in zip(*[batch.column(c).to_pylist() for c in ("start", "n_tokens", "root", "digests", "ends")], strict=True):
            if merkle(digests) != root or ends[-1] != total:
                raise ValueError(f"the recipe at {start} does not match its root")
            out["start"] += [start] * len(ends)
            out["ordinal"] += range(len(ends))
            out["key"] += digests
            out["n"] += [e - b for b, e in zip([0, *ends], ends)]  # noqa: B905
            out["after"] += [total - e for e in ends]
        return out

    return map_arrow(store.recipes, run, "start bigint, ordinal int, key binary, n bigint, after bigint")


def _checked_chunks(store: TokenStore) -> DataFrame:
    """key, ids and CRC-32 (of 32-bit ids) of every chunk, after it has been checked against its digest."""
    width_type = f"<u{store.width}"

    def run(batch: pa.RecordBatch) -> dict:
        keys, crcs, sizes = batch.column("key").to_pylist(), [], []
        for key, data in zip(keys, batch.column("data").to_pylist(), strict=True):
            if hashlib.sha256(data).digest() != key:
                raise ValueError("a chunk does not match its digest")
            ids = np.frombuffer(data, dtype=width_type)
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            sizes.append(len(ids))
        return {"key": batch.column("key"), "ids": sizes, "crc": crcs}

    return map_arrow(store.chunks, run, "key binary, ids bigint, crc bigint")


def read_documents(store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    spark = store.spark
    scratch = Scratch(spark, "readback")
    off = _segments(store.recipes).exceptAll(store.manifest.select("segment", "documents", "ids", "digest"))
    if off.limit(1).count():
        raise ValueError("the recipes do not match the manifest")
    refs = scratch.write(_references(store), "references")
    used = refs.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    known = scratch.write(_checked_chunks(store).join(used, "key", "inner"), "checked")
    joined = join_groups(refs, known, ["key"], "rows").select("start", "n", "after", "ids", "crc")

    def run(batch: pa.RecordBatch) -> dict:
        n, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "ids"))
        if not np.array_equal(n, ids):
            raise ValueError("a chunk is missing or has another length")
        moved = moved_crc(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
        return {"start": batch.column("start"), "ids": batch.column("ids"), "crc": moved.astype(np.int64)}

    parts = map_arrow(joined, run, "start bigint, ids bigint, crc bigint")
    sums = parts.groupBy("start").agg(F.sum("ids").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    out = scratch.write(store.recipes.select("doc_id", "start").join(sums, "start", "left").select("doc_id", "start", "n_tokens", "ids_crc32"), "documents")
    scratch.drop("references", "checked")
    return out


def reconstruct(store: TokenStore) -> DataFrame:
    """doc_id, start and ids: whole documents, each put together from its chunks in one row."""
    joined = _references(store).join(store.chunks, "key")
    whole = joined.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data"))).alias("parts"))
    width_type = f"<u{store.width}"

    def run(batch: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(b"".join(p["data"] for p in parts), dtype=width_type).astype(np.int32) for parts in batch.column("parts").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": [x.tolist() for x in ids]}

    return map_arrow(store.recipes.select("doc_id", "start").join(whole, "start"), run, f"doc_id {store.id_type}, start bigint, ids array<int>")
