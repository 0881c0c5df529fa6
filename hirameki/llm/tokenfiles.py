"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Texts are dealt into ranges of doc_id and encoded there, so the files follow one another in ascending order. A file
holds doc_id, part (its range), local_start (ids of the range before the document), n_tokens and ids as a list of
integers, which ORC stores in run-length encoded streams. Stripes are read in parallel; a filter on doc_id goes to the
files' statistics, row indexes and Bloom filters.

Nulls: a null text has the end id alone; null doc_ids come last. Rows that share a doc_id follow each other, by their
text. An empty table makes files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, n_buckets, tidied
from .encoders import ENCODED_BYTES, encoder

FILE_DDL = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.compress": "LZ4",
}

#: Files whose offsets (16 bytes each) are broadcast; those of more are joined by a shuffle.
MOST_FILES = 1_000_000


def encoding(path: str, rule: str, end_id: int):
    """mapInArrow function: doc_id and text in order to the rows of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in filled(batches, "text", ENCODED_BYTES):
            encoded = encoder(path, rule).encode(batch.column("text"))
            lengths = encoded.lengths + 1
            ends = np.cumsum(lengths)
            flat = np.insert(encoded.flat.astype(np.int32), encoded.starts + encoded.lengths, end_id)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(lengths), part, np.int32)), pa.array(start + ends - lengths), pa.array(lengths), ids], ["doc_id", "part", "local_start", "n_tokens", "ids"]
            )
            start += int(ends[-1])

    return run


def write(docs: DataFrame, to: str, path: str, rule: str = "drop", text: str = "text", doc_id: str = "doc_id", end_id: int = 2, file_mb: int = 64) -> None:
    """Writes the ids of docs, each with end_id, as ORC files in the folder `to`, in ascending order of doc_id."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(n_buckets(docs, file_mb), order[0]).sortWithinPartitions(*order)
    dealt.mapInArrow(tidied(encoding(path, rule, end_id)), FILE_DDL).write.options(**ORC).orc(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id are pushed to the files."""
    rows = spark.read.schema(FILE_DDL).orc(path)
    # a row per file, so the window is as long as the list of files, and so is the broadcast, whose length is checked
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if len(rows.inputFiles()) <= MOST_FILES else before
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: doc_id, start, n_tokens, ids to the same with ids_crc32 in place of ids."""
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
