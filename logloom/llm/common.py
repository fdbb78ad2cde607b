"""What several operators of this package share: scratch folders, stores, id ranges, row streams."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most cells of a histogram from which id ranges are cut; bounds what reaches the driver.
CELLS = 1 << 18


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of long texts at once: rows and bytes of an Arrow batch."""
    rows, most = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048
    if not 0 < int(spark.conf.get(rows)) <= most:
        spark.conf.set(rows, str(most))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def release() -> None:
    """Give a worker's free memory back to the machine; workers live on and other tasks need it."""
    import ctypes

    from . import hashing

    hashing.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What operators remember in a worker, by operator, and how to forget it.
_remembered: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called as a task of ``owner`` begins: what other operators remember in this worker is forgotten, so that the
    stages of a pipeline, which share workers, do not add up."""
    for name in [n for n in _remembered if n != owner]:
        _remembered.pop(name)()
    if forget is not None:
        _remembered[owner] = forget


def releasing(work):
    """``work`` (a function of an iterator that yields) with :func:`claim` before and :func:`release` after it."""

    @functools.wraps(work)
    def wrapped(parts):
        claim(work.__module__)
        try:
            yield from work(parts)
        finally:
            release()

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) in the folder that the whole cluster shares.

    ``spark.checkpoint.dir`` names it. Where it is unset, a folder of this machine serves, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + os.path.join(tempfile.gettempdir(), "logloom-scratch")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/logloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` as a table in ``path``: a cut of the lineage that outlives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    """Files of a shared folder, as seen from Python on the driver and the executors."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.root, self.fs = unquote(parts.path), None
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        if self.local:
            os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
            return open(self.path(name), "wb")
        self.fs.create_dir(os.path.dirname(self.path(name)), recursive=True)
        return self.fs.open_output_stream(self.path(name))

    def open(self, name: str):
        return open(self.path(name), "rb") if self.local else self.fs.open_input_file(self.path(name))

    def commit(self, temporary: str, name: str) -> None:
        """Give a complete file its name. Attempts of one task write equal bytes, so the last one may win."""
        if self.local:
            os.replace(self.path(temporary), self.path(name))
        else:
            from pyarrow import fs

            if self.fs.get_file_info(self.path(name)).type != fs.FileType.NotFound:
                self.fs.delete_file(self.path(name))
            self.fs.move(self.path(temporary), self.path(name))

    def put(self, name: str, data: bytes) -> None:
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        with self.create(temporary) as out:
            out.write(data)
        self.commit(temporary, name)

    def get(self, name: str) -> bytes:
        with self.open(name) as source:
            return source.read()


def partitions(spark: SparkSession, shards: int = 0) -> int:
    """Partitions for shuffles that carry whole texts: twice the session's, so that tasks hold little, and more
    where the count of shards says that the data need them."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 2)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of ``df`` that have none of the names ``made`` (in any case): new columns take the others' place."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def apart(df: DataFrame, *made: str, **used: Column) -> tuple[DataFrame, list[str], list[Column]]:
    """``df`` with its columns but ``made`` as c0, c1, ... beside the named columns, so that no name of the caller's can
    meet a helper's; the names c0, c1, ...; and the columns that give the caller's names back. Columns stay columns, so
    that those which nothing needs are not read."""
    keep = others(df, *made)
    own = [f"c{k}" for k in range(len(keep))]
    rows = df.select(*(column(c).alias(k) for c, k in zip(keep, own, strict=True)), *(c.alias(k) for k, c in used.items()))
    return rows, own, [F.col(k).alias(c) for c, k in zip(keep, own, strict=True)]


_SIGN = 1 << 63


def id_ranges(df: DataFrame, id_col: str, weight: Column, shard_bytes: int) -> tuple[Column, int]:
    """An expression for the number of a row's id range, ascending with the id, and the count of ranges.

    Ranges hold about equal weight (bytes), ``shard_bytes`` or less where more than one row is in them. Their edges
    are quantiles of the weight, from a histogram over prefixes of the ids' bits; a cell that holds more than half a
    range (other than by one row) is cut again by more bits, so ids that lie close together or one that lies far out
    change nothing. Edges depend on the rows alone, not on a sample or on how rows are spread. At most :data:`CELLS`
    cells reach the driver in a round; the edges, eight bytes a range and at most one for each cell, are broadcast.
    Null ids belong to the last range.
    """
    spark = df.sparkSession
    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").bitwiseXOR(F.lit(-_SIGN)).alias("x"), weight.alias("w"))
    low, high, rows = df.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()  # reads the ids alone
    if low is None:
        return F.lit(0), 1
    fewest = 2 * partitions(spark)
    width = ((low + _SIGN) ^ (high + _SIGN)).bit_length()
    shift = max(0, width - (min(CELLS, 16 * max(fewest, rows * 8192 // shard_bytes)) - 1).bit_length())
    leaves: dict[int, int] = {}
    part, total, shards = keyed, 0, fewest
    while True:
        cells = part.groupBy(F.shiftrightunsigned("x", shift).alias("cell")).agg(F.sum(F.col("w") + F.lit(1)), F.max("w")).collect()
        if not total:
            total = sum(w for _, w, _ in cells)
            shards = min(CELLS, max(fewest, -(-total // shard_bytes)))
        heavy = []
        for cell, w, most in cells:
            if shift and 2 * (w - most) * shards > total:
                heavy.append((cell,))
            else:
                leaves[(cell % (2 * _SIGN)) << shift] = w
        if not heavy:
            break
        deeper = max(0, shift - max(1, (CELLS // len(heavy)).bit_length() - 1))
        hot = F.broadcast(spark.createDataFrame(heavy, "cell long"))  # CELLS rows at most
        part, shift = keyed.join(hot, F.shiftrightunsigned("x", shift) == F.col("cell"), "left_semi"), deeper
    starts, so_far, last = [], 0, -1
    for start in sorted(leaves):
        if (number := so_far * shards // total) != last:
            starts.append(start)
            last = number
        so_far += leaves[start]
    edges = spark.sparkContext.broadcast(np.array([0, *starts[1:]], np.uint64))

    @F.arrow_udf("int")
    def shard(ids: pa.Array) -> pa.Array:
        x = ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
        return pa.array(np.searchsorted(edges.value, x, "right") - 1, pa.int32())

    return shard(F.col(id_col).cast("long")), len(starts)


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows dealt by their ``shard``, evenly: range k goes to partition k modulo the count of partitions."""
    n = min(partitions(rows.sparkSession, shards), max(1, shards))
    return rows.repartitionById(n, F.pmod(F.col("shard"), F.lit(n)).cast("int"))


#: Bits of a filter of ids at most, and for each id.
FILTER_BITS, FILTER_ROOM = 27, 16
_FILTER = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def may_be_in(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition on a column of ids that holds for each one among ``ids`` (column id, long) and for few others: a Bloom
    filter of 2^:data:`FILTER_BITS` bits (16 MB) at most, so that it can be broadcast. Its words are made on the
    executors. With more ids than it has room for it lets more through, and loses none; nulls are not among any ids."""
    spark = ids.sparkSession
    bits = min(FILTER_BITS, max(10, (FILTER_ROOM * ids.count()).bit_length()))

    def places(x: np.ndarray) -> Iterator[np.ndarray]:
        h = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        for m in _FILTER:
            yield ((h ^ (h >> np.uint64(29))) * m) >> np.uint64(64 - bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in places(batch.column(0).drop_null().to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "mask"])

    table = ids.select("id").mapInArrow(slots, "at int, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # the filter
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[table["at"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def among(column: pa.Array) -> pa.Array:
        x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        found = np.array(column.is_valid().to_numpy(zero_copy_only=False))
        for at in places(x):
            found &= (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(found)

    return among


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` (whose columns are long texts) whose id is not among ``gone`` (column id, long). Only rows that
    a filter of these ids lets through are joined, so that the others are not shuffled."""
    among = may_be_in(gone)(column(key).cast("long"))
    own = f"gone-{uuid.uuid4().hex}"  # no column of the caller's has this name
    rest = df.where(among).join(gone.select(F.col("id").alias(own)), column(key) == column(own), "left_anti")
    return df.where(~among).union(rest)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, in the order of the columns."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, bounded in rows and in bytes of text."""
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= size or held_bytes >= most_bytes:
            yield batch_of(held, schema)
            held, held_bytes = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blocks_of(rows: Iterable[tuple], text: int, size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Lists of rows with about ``size`` characters in column ``text``."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text] or "") + 64
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def runs_by_key(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of rows that agree in the first ``keys`` columns; needs sorted rows."""
    current, held = None, []
    for row in rows_of(batches):
        if row[:keys] != current and held:
            yield current, held
            held = []
        current = row[:keys]
        held.append(row)
    if held:
        yield current, held
