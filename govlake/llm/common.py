"""What the text operators share: tables in the shared folder, hot groups, running totals.

Intermediate results that several later jobs read are written as Parquet below the folder
that the cluster names in ``spark.checkpoint.dir``: a lost executor then costs a re-read, not
the lineage. Only where that setting is absent *and* the master is local (tests) a temporary
folder is used.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separators of "words" in most contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)

#: Measured bytes up to which a table is broadcast.
FEW_BYTES = 16 << 20

_own: dict[str, str] = {}
_bases: set[str] = set()


def written() -> set[str]:
    """Folders that operator calls of this process may still have tables in."""
    return set(_bases)


def release(spark: SparkSession, bases: set[str]) -> None:
    """Delete such folders, once nothing reads what the calls returned."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for base in bases:
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(conf).delete(path, True)
        _bases.discard(base)


def _clear() -> None:
    """What this process has written into the shared folder goes when it ends, also after a failure."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the store may be out of reach by now
            release(spark, written())


atexit.register(_clear)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="govlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


class Scratch:
    """Written tables of one operator call; ``drop`` removes those that no later plan reads, the end of the process the rest.

    The first one of a session sets the size of its Arrow batches (``BATCH_SETTING``).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/govlake/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}
        _bases.add(self.base)
        if spark.conf.get(BATCH_SETTING, None) != BATCH_BYTES:  # texts are of any length: batches by bytes, not by rows alone
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)

    def path(self, name: str) -> str:
        self.n += 1
        if name in self.paths:  # the older one goes at the end, with all others
            self.paths[f"{name}@{self.n}"] = self.paths[name]
        self.paths[name] = f"{self.base}/{self.n}-{name}"
        return self.paths[name]

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write and read again; the schema is given, so no job infers it and empty tables work."""
        path, writer = self.path(name), df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables (all, if none is named) and let Spark's cleaner free old shuffle files."""
        jvm = self.spark.sparkContext._jvm
        for name in names or list(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        free(self.spark)


def free(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def blobs(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def give_back() -> None:
    """Return what has been freed to the system: Python lives on beside the heap of the driver or executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns (a dict of lists or arrays)."""
    typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(typed)
        for batch in batches:
            if batch.num_rows and (made := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in out], schema=out)
                made = batch = None
        give_back()

    return df.mapInArrow(run, typed)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], rows: str, shards: int = 4096) -> DataFrame:
    """``left LEFT JOIN groups`` where ``groups`` has one row per key and the key's rows of ``left`` in ``rows``.

    Keys with more than 1/shards of all rows number fewer than ``shards`` by construction, so they
    are broadcast and their rows stay where they are. The others are shuffled: none of them has
    more than 1/shards of the rows. ``left`` should be a written table, as it is read twice. Null keys match.
    """
    total = groups.agg(F.sum(rows)).first()[0] or 0
    cut = max(1, total // shards)
    mine = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[F.col(c) for c in groups.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        on = same if on is None else on & same
    drop = [f"_g_{k}" for k in keys]
    hot, cold = mine.filter(F.col(rows) > cut), mine.filter(F.col(rows) <= cut)
    near = left.join(F.broadcast(hot), on, "inner").drop(*drop)
    far = left.join(F.broadcast(hot.select(*drop)), on, "left_anti").join(cold, on, "left").drop(*drop)
    return near.unionByName(far)


def running_totals(scratch: Scratch, df: DataFrame, order: list[Column], value: str, group: str | None = None, name: str = "ranged") -> DataFrame:
    """Add ``before``: the sum of the non-negative ``value`` over all rows that come earlier in ``order`` (of the same ``group``).

    ``order`` must begin with the group. The rows are range-partitioned, so a hot group spreads
    over many tasks; each task sums its own sorted run, and only one total per task and group is
    summed in order. The ranged rows are a written table: their partition numbers stay fixed
    when an executor is lost.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, pid = to_arrow_schema(schema), TaskContext.get().partitionId()
        last, total = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(value).to_numpy(zero_copy_only=False), dtype=np.int64)
            cum = np.cumsum(v) - v
            local = np.empty(len(v), dtype=np.int64)
            if group is None:
                starts, keys = [0], [None]
            else:
                codes = batch.column(group).dictionary_encode()
                ids = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts = [0, *(np.flatnonzero(np.diff(ids)) + 1)]
                names = codes.dictionary.to_pylist()
                keys = [names[ids[s]] if ids[s] >= 0 else None for s in starts]
            for s, e, key in zip(starts, [*starts[1:], len(v)], keys, strict=True):
                total = total if key == last else 0
                local[s:e] = cum[s:e] - cum[s] + total
                total += int(v[s:e].sum())
                last = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(local)], schema=out)

    ranged = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    keys = ["_pid", *([group] if group else [])]
    ends = ranged.groupBy(*keys).agg(F.max(F.col("_local") + F.col(value)).alias("_sum"))
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(ends.withColumn("_offset", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum"), name + "-offsets")
    few = measured_bytes(offsets) <= FEW_BYTES  # one row per task and group
    mine = offsets.select(*[F.col(k).alias(f"_o{k}") for k in keys], "_offset")
    on = F.col("_pid") == F.col("_o_pid")
    if group:
        on &= F.col(group).eqNullSafe(F.col(f"_o{group}"))
    return ranged.join(F.broadcast(mine) if few else mine, on, "left").withColumn("before", F.col("_local") + F.col("_offset")).drop("_pid", "_local", "_offset", *[f"_o{k}" for k in keys])


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of a written table, as they lie in memory but for the rows' own overhead."""

    def size(f: T.StructField, c: Column) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(f.dataType, T.StructType):
            return reduce(lambda a, b: a + b, [size(g, c[g.name]) for g in f.dataType], F.lit(16))
        if isinstance(f.dataType, T.ArrayType):  # of numbers or short texts
            return F.coalesce(F.size(c), F.lit(0)) * 32 + 16
        return F.lit(8)

    total = reduce(lambda a, b: a + b, [size(f, F.col(f"`{f.name}`")) for f in df.schema], F.lit(8))
    return int(df.agg(F.sum(total.cast("long"))).first()[0] or 0)


def attach(left: DataFrame, groups: DataFrame, keys: list[str], rows: str, few: int = FEW_BYTES) -> DataFrame:
    """``join_groups``, or one broadcast join where ``groups`` (a written table) has few bytes, which are measured."""
    if measured_bytes(groups) > few:
        return join_groups(left, groups, keys, rows)
    mine = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[F.col(c) for c in groups.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        on = same if on is None else on & same
    return left.join(F.broadcast(mine), on, "left").drop(*[f"_g_{k}" for k in keys])


def word_count(text: Column | str) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _same_document(kept: DataFrame) -> tuple[DataFrame, Column]:
    """doc_id and text_key of ``kept`` under names of their own, and the condition that a packed row is one of them."""
    mine = kept.select(F.col("doc_id").alias("_k_doc_id"), F.col("text_key").alias("_k_text_key"))
    return mine, (F.xxhash64("row.text") == F.col("_k_text_key")) & F.col("row.doc_id").eqNullSafe(F.col("_k_doc_id"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose doc_id and text (by ``text_key``) are in ``kept``."""
    mine, same = _same_document(kept)
    return packed(docs).join(mine, same, "left_semi").select("row.*")


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are not in ``gone`` (a written table): texts move only where it is too large to be broadcast."""
    mine, same = _same_document(gone)
    return packed(docs).join(F.broadcast(mine) if measured_bytes(gone.select("doc_id", "text_key")) <= FEW_BYTES else mine, same, "left_anti").select("row.*")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` in one column ``row``, so that no name of its columns clashes with another."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
