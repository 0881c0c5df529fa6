"""What the operators of this subpackage share: written tables, Arrow text buffers, rolling hashes, packed rows."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirameki.cluster import shared_dir

#: White space that parts words; a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id where documents are ordered: after every number.
LAST = (1 << 63) - 1
#: Bytes of text that one numpy pass takes, unless a single document is larger.
BLOCK_BYTES = 2 << 20

#: Tables that this session has written and not removed, with what it takes to remove them.
_tables: dict[str, tuple] = {}
_scopes: list[list[str]] = []


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared folder and read again, and its path: cuts lineage, survives lost executors.

    The table goes with removed(), at the end of the scratch() that it was made in, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _tables[path] = (at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(path: str) -> None:
    """Deletes a table that written() made."""
    if path in _tables:
        files, at = _tables.pop(path)
        files.delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside go at its end: what is made of them has to be written outside, or before it in a scope around it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            removed(path)


def result(make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written, and the tables that it needed removed: only the result's own table stays."""
    with scratch():
        out, path = written(make())
        _scopes[-1].remove(path)
    if _scopes:
        _scopes[-1].append(path)
    return out


@atexit.register
def _sweep() -> None:
    with suppress(Exception):  # the JVM may be gone
        for path in list(_tables):
            removed(path)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a mapInArrow function; a worker gives the memory of a task back when the task ends, as it waits for more."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError):  # not in every C library
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def n_buckets(df: DataFrame, bucket_mb: int = 64) -> int:
    """So many partitions that one gets about bucket_mb of df as the planner sizes it, the session's shuffle partitions at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size >> 20, 1 << 40) // bucket_mb) if size < 1 << 60 else least


def ordered(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (all columns of df), ord (doc_id, null last), key (hash of doc_id and text; 32 bits where there is a doc_id), text (null: empty).

    (ord, key) names a row; rows that share both are equal in doc_id and text.
    """
    hashed = F.xxhash64(F.col(doc_id), F.col(text))
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("ord"),
        F.when(F.col(doc_id).isNull(), hashed).otherwise(hashed.bitwiseAND(F.lit((1 << 32) - 1))).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def overlaid(df: DataFrame, row: str, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of the struct row, those named in new replaced or appended."""
    kept = [new[c].alias(c) if c in new else F.col(f"{row}.`{c}`") for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in new.items() if k not in columns])


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the text goes beyond block_bytes; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + block_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def filled(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """blocks() of batches that are joined first: each but the last holds about block_bytes of text."""
    waiting, size = [], 0
    for batch in batches:
        mine = int(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0)
        if waiting and size + mine > block_bytes:
            yield from blocks([_joined(waiting)], column, block_bytes)
            waiting, size = [], 0
        waiting.append(batch)
        size += mine
    if waiting:
        yield from blocks([_joined(waiting)], column, block_bytes)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins and the last ends."""
    texts = pc.fill_null(column.cast(pa.large_string()), "") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the runs of bytes that aren't in parts and don't cross a text's end."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~parts[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def byte_table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


IS_SPACE = byte_table(SPACES)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words."""
    return spans(data, offsets, IS_SPACE)


#: Odd multipliers of two polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Values whose powers are at hand.
CHUNK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse, CHUNK and one of each."""
    if base not in _powers:
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(CHUNK + 1, x, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[base] = tuple(made)
    return _powers[base]


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of stretches that follow one another, a chunk at a time: memory doesn't grow with values or with a stretch."""
    up, down = powers(base)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        to = int(np.searchsorted(ends, at + CHUNK, side="right"))
        if to <= i:  # longer than a chunk
            total, end = 0, int(ends[i])
            for k in range(at, end, CHUNK):
                part = values[k : min(k + CHUNK, end)].astype(np.uint64) + np.uint64(1)
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(base, k - at, 1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        part = values[at : int(ends[to - 1])].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, dtype=np.uint64, out=sums[1:])
        a, b = starts[i:to] - at, ends[i:to] - at
        out[i:to] = (sums[b] - sums[a]) * down[a]
        i = to
    return mixed(out + (ends - starts).astype(np.uint64))


class Rolling:
    """Hashes of any stretches of a sequence of integers, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64, out=self.sums[1:])
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length : length + n] - self.sums[:n]) * self.back[:n] + np.uint64(length))


def begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)
