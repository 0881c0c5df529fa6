"""Packed questions and answers: what a block of documents asks by hash, and what comes back to its documents.

A task packs its block's questions into one binary per bucket; buckets answer with one binary per bucket of documents;
those are unpacked to one row per document. So rows of the exchanges are as many as blocks times buckets, and a hash
that many documents share travels once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LAST, begins

#: A row of the exchange: packed questions to a bucket (ord null), or an answer that needs none.
ASKED = pa.schema([("bucket", pa.int32()), ("ord", pa.int64()), ("key", pa.int64()), ("data", pa.binary())])
ANSWERED = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
GATHERED = pa.schema([("ord", pa.int64()), ("key", pa.int64()), ("answers", pa.binary())])
ASKED_DDL, ANSWERED_DDL, GATHERED_DDL = "bucket int, ord long, key long, data binary", "bucket int, data binary", "ord long, key long, answers binary"
#: An answer: the document and a word position.
ANSWER = np.dtype([("ord", "<i8"), ("key", "<i8"), ("pos", "<u4")])
#: A question: hash, more bits of it, document in the block's table, word position, and a flag.
QUESTION = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<u4"), ("pos", "<u4"), ("more", "u1")])


def known_rows(said: np.ndarray, ords: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Answers that the block itself gives: doc and pos of said."""
    if len(said):
        said = said[np.argsort(said["doc"], kind="stable")]
        at = np.flatnonzero(begins(said["doc"]))
        docs = said["doc"][at]
        data = [x.tobytes() for x in np.split(said["pos"], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array((keys[docs] & 0x7FFFFFFF).astype(np.int32)), pa.array(ords[docs]), pa.array(keys[docs]), pa.array(data, pa.binary())], schema=ASKED)


def narrow(values: np.ndarray) -> bytes:
    """64-bit integers as the least and 32-bit differences, or as they are if those don't fit (then the least is the largest there is)."""
    low = int(values.min())
    if int(values.max()) - low < 1 << 32 and low != LAST:
        return np.int64(low).tobytes() + (values - low).astype("<u4").tobytes()
    return np.int64(LAST).tobytes() + values.tobytes()


def widened(raw, n: int, at: int) -> tuple[np.ndarray, int]:
    """n values of narrow() in a buffer, and where they end."""
    low = int(np.frombuffer(raw, "<i8", 1, at)[0])
    if low == LAST:
        return np.frombuffer(raw, "<i8", n, at + 8), at + 8 + 8 * n
    return np.frombuffer(raw, "<u4", n, at + 8).astype(np.int64) + low, at + 8 + 4 * n


def asked_rows(asked: np.ndarray, ords: np.ndarray, keys: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The questions, a row per bucket."""
    if len(asked):
        order = np.lexsort((asked["pos"], asked["doc"], bucket))
        asked, bucket = asked[order], bucket[order]
        at = np.flatnonzero(begins(bucket))
        data = []
        for x in np.split(asked, at[1:]):
            docs, doc = np.unique(x["doc"], return_inverse=True)
            cols = (x["h"], x["g"], doc.astype("<u2" if len(docs) < 1 << 16 else "<u4"), x["pos"], x["more"])
            data.append(b"".join([np.array([len(docs), len(x)], "<u4").tobytes(), narrow(ords[docs]), narrow(keys[docs]), *(np.ascontiguousarray(c).tobytes() for c in cols)]))
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), none, none, pa.array(data, pa.binary())], schema=ASKED)


def read_asked(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """Of whole buckets: the answers already known, and the questions' h, g, ord, key, pos, more."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    found = []
    for batch in batches:
        known = batch.filter(batch.column("ord").is_valid())
        if known.num_rows:
            sizes = np.array([len(b.as_buffer()) // 4 for b in known.column("data")])
            x = np.zeros(int(sizes.sum()), ANSWER)
            x["ord"], x["key"] = np.repeat(known.column("ord").to_numpy(), sizes), np.repeat(known.column("key").to_numpy(), sizes)
            x["pos"] = np.frombuffer(b"".join(known.column("data").to_pylist()), "<u4")
            found.append(x)
        for blob in batch.filter(batch.column("ord").is_null()).column("data"):
            raw = blob.as_buffer()
            docs, n = np.frombuffer(raw, "<u4", 2).tolist()
            ords, at = widened(raw, docs, 8)
            keys, at = widened(raw, docs, at)
            columns = []
            for kind, count in (("<u8", n), ("<u4", n), ("<u2" if docs < 1 << 16 else "<u4", n), ("<u4", n), ("u1", n)):
                columns.append(np.frombuffer(raw, kind, count, at))
                at += columns[-1].nbytes
            h, g, doc, pos, more = columns
            for to, x in zip(parts, (h, g, ords[doc], keys[doc], pos, more), strict=True):
                to.append(x)
    kinds = ("<u8", "<u4", "<i8", "<i8", "<u4", "u1")
    return found, tuple(np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True))


def answer_rows(found: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The answers, a row per bucket of documents."""
    x = np.concatenate([np.zeros(0, ANSWER), *found])
    if not len(x):
        return
    to = (x["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((x["pos"], x["key"], to))
    x, to = x[order], to[order]
    at = np.flatnonzero(begins(to)).tolist()
    for lo, hi in zip(at, [*at[1:], len(to)], strict=True):
        mine = x[lo:hi]
        at_doc = np.flatnonzero(begins(mine["ord"], mine["key"]))
        counts = np.diff(np.append(at_doc, len(mine))).astype("<u4")
        docs = mine[at_doc]
        data = b"".join([np.array([len(docs)], "<u4").tobytes(), narrow(docs["ord"]), narrow(docs["key"]), counts.tobytes(), mine["pos"].tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([to[lo]], pa.int32()), pa.array([data], pa.binary())], schema=ANSWERED)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over ANSWERED of whole buckets: a row per document, with all positions."""
    found = []
    for batch in batches:
        for blob in batch.column("data"):
            raw = blob.as_buffer()
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            ords, at = widened(raw, n, 4)
            keys, at = widened(raw, n, at)
            counts = np.frombuffer(raw, "<u4", n, at)
            x = np.zeros(int(counts.sum()), ANSWER)
            x["ord"], x["key"], x["pos"] = np.repeat(ords, counts), np.repeat(keys, counts), np.frombuffer(raw, "<u4", len(x), at + 4 * n)
            found.append(x)
    if not found:
        return
    x = np.concatenate(found)
    x = x[np.lexsort((x["pos"], x["key"], x["ord"]))]
    at = np.flatnonzero(begins(x["ord"], x["key"]))
    for i in range(0, len(at), 10_000):
        part = at[i : i + 10_000]
        mine = x[part[0] : at[i + 10_000] if i + 10_000 < len(at) else len(x)]
        data = [p.tobytes() for p in np.split(mine["pos"], part[1:] - part[0])]
        yield pa.RecordBatch.from_arrays([pa.array(x["ord"][part]), pa.array(x["key"][part]), pa.array(data, pa.binary())], schema=GATHERED)
