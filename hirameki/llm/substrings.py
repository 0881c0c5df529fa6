"""Substring dedup by level-wise doubling.

A window of `window` words repeats only if each of its parts does. So the first level tests, of each window, the
one part of `start` words with the smallest hash (the same part wherever the window stands, so it repeats with the
window); only windows whose part repeats are extended to parts of twice the length, until the length is that of the
window. There every surviving window asks for the earliest document that has it.

Each level is one exchange by hash: a task packs, of its block of documents, every distinct hash once per bucket,
after it has settled what the block itself shows. So a passage that a third of all documents share reaches its bucket
once per block, not once per document. Answers (word positions) go back to their documents.

Nulls: a null text has no words and is kept; a null doc_id comes after all numbers. Documents that share a doc_id are
neither earlier than the other. A document equal in its words to an earlier one is removed as a whole if it has a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, begins, blocks, n_buckets, ordered, overlaid, stretch_hashes, text_bytes, tidied, words
from .exchange import ANSWER, ANSWERED_DDL, ASKED, ASKED_DDL, GATHERED_DDL, QUESTION, answer_rows, asked_rows, gathered, known_rows, read_asked

#: Position that stands for the document as a whole.
WHOLE = 0xFFFFFFFF


def levels(window: int, start: int) -> list[int]:
    """Lengths from start by doubling, ending with window."""
    if not 1 <= start <= window:
        raise ValueError("1 <= start <= window")
    lengths = [start]
    while lengths[-1] * 2 < window:
        lengths.append(lengths[-1] * 2)
    return lengths if lengths[-1] == window else [*lengths, window]


class Block:
    """Word hashes of some documents, and of their windows."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.starts, self.ends, self.doc = words(data, offsets)
        self.data, self.offsets = data, offsets
        by_byte = [stretch_hashes(data, self.starts, self.ends, b) for b in BASES]
        self.rolls = [Rolling(h, b) for h, b in zip(by_byte, BASES[::-1], strict=True)]
        self.first = np.searchsorted(self.starts, offsets)  # number of each document's first word

    def windows(self, window: int) -> np.ndarray:
        """First words of all windows."""
        n = max(0, len(self.doc) - window + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[window - 1 : window - 1 + n])

    def part(self, at: np.ndarray, window: int, length: int) -> np.ndarray:
        """Of the windows that begin at the words, where the part of that length with the smallest hash begins."""
        h = self.rolls[0].windows(length)
        best, where = h[at].copy() if len(at) else np.zeros(0, np.uint64), at.copy()
        for j in range(1, window - length + 1):
            other = h[at + j]
            less = other < best
            best[less], where[less] = other[less], at[less] + j
        return where


def local_positions(block: Block, blobs: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the block the answers name (True at the word), and which documents they name as a whole."""
    named, whole = np.zeros(len(block.doc), bool), np.zeros(n, bool)
    for i, b in enumerate(blobs):
        if b:
            pos = np.frombuffer(b, "<u4")
            if (pos == WHOLE).any():
                whole[i], pos = True, pos[pos != WHOLE]
            named[block.first[i] + pos.astype(np.int64)] = True
    return named, whole


def packed(entries: np.ndarray, ords: np.ndarray, keys: np.ndarray, later: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The block's questions by bucket, and the answers that the block itself gives.

    later: entries that ask whether an earlier document has the hash; the others ask whether it occurs anywhere else.
    """
    o = ords[entries["doc"]]
    order = np.lexsort((entries["pos"], entries["doc"], o, entries["g"], entries["h"]))
    e, o, later, bucket = entries[order], o[order], later[order], bucket[order]
    new = begins(e["h"], e["g"])
    group = np.cumsum(new) - 1
    if len(e):
        size = np.bincount(group)[group]
        first = np.flatnonzero(new)[group]
        own = (o == o[first]) & begins(group, e["doc"])  # the earliest document, at its first place
        known = np.where(later, ~own, size > 1)
        e["more"] = size > 1
        ask = np.where(later, own, new)
    else:
        known = ask = np.zeros(0, bool)
    yield from known_rows(e[known], ords, keys)
    yield from asked_rows(e[ask], ords, keys, bucket[ask])


def questions(lengths: list[int], level: int, buckets: int, text: int | None = None):
    """mapInArrow function: text (and answers of the level before) to rows of ASKED. text: its place in a struct `row`."""
    window, length, last = lengths[-1], lengths[level], level == len(lengths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches if text is None else with_text(batches, text)):
            block, n = Block(batch.column("text")), batch.num_rows
            ords, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
            at = block.windows(window)
            if level:
                alive, whole = local_positions(block, batch.column("answers").to_pylist(), n)
                at = at[alive[block.part(at, window, lengths[level - 1])]]
                at = at[~whole[block.doc[at]]]
                if whole.any():  # known to be gone: nothing to ask, the answer goes on
                    gone = np.flatnonzero(whole)
                    yield pa.RecordBatch.from_arrays([pa.array((keys[gone] & 0x7FFFFFFF).astype(np.int32)), pa.array(ords[gone]), pa.array(keys[gone]), pa.array([WHOLE.to_bytes(4, "little")] * len(gone), pa.binary())], schema=ASKED)
            if last:
                place, by = at, block.rolls[0].windows(lengths[level - 1])[block.part(at, window, lengths[level - 1])] if level else None
            else:
                place = np.unique(block.part(at, window, length))
                by = None
            h = [r.windows(length)[place] for r in block.rolls]
            e = np.zeros(len(place), QUESTION)
            e["h"], e["g"], e["doc"], e["pos"] = h[0], h[1] & np.uint64(0xFFFFFFFF) if last else 0, block.doc[place], place - block.first[block.doc[place]]
            bucket = ((by if by is not None else h[0]) >> np.uint64(8)) % np.uint64(buckets)
            later = np.full(len(e), last)
            if not level and not last:  # documents of the same words: only the earliest goes on
                lo, hi = block.first[:-1], block.first[1:]
                long = np.flatnonzero(hi - lo >= window)
                w = np.zeros(len(long), QUESTION)
                a, b = (r.of(lo[long], hi[long]) for r in block.rolls)
                w["h"], w["g"], w["doc"], w["pos"] = a, (b >> np.uint64(32)) | np.uint64(1), long, WHOLE  # g is odd or more than 0: apart from the windows
                e, bucket, later = np.concatenate([e, w]), np.concatenate([bucket, (a >> np.uint64(8)) % np.uint64(buckets)]), np.concatenate([later, np.ones(len(w), bool)])
            yield from packed(e, ords, keys, later, bucket.astype(np.int64))

    return run


def answers(last: bool, buckets: int):
    """mapInArrow function over the rows of ASKED of whole buckets: rows of ANSWERED, one per bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, (h, g, o, k, pos, more) = read_asked(batches)
        if len(h):
            order = np.lexsort((o, g, h))
            h, g, o, k, pos, more = h[order], g[order], o[order], k[order], pos[order], more[order].astype(bool)
            new = begins(h, g)
            group = np.cumsum(new) - 1
            yes = o > o[np.flatnonzero(new)[group]]  # an earlier document has it
            if not last:
                repeated = (np.bincount(group) > 1) | (np.bincount(group, more) > 0)
                yes = np.where(pos == WHOLE, yes, repeated[group] & ~more)
            x = np.zeros(int(yes.sum()), ANSWER)
            x["ord"], x["key"], x["pos"] = o[yes], k[yes], pos[yes]
            found.append(x)
        yield from answer_rows(found, buckets)

    return run


def covered(starts: np.ndarray, window: int, doc_of: np.ndarray) -> np.ndarray:
    """Words inside a window that begins at a marked word."""
    edge = np.zeros(len(starts) + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, len(starts)), -1)
    return np.cumsum(edge[:-1]) > 0


def with_text(batches: Iterator[pa.RecordBatch], field: int) -> Iterator[pa.RecordBatch]:
    """The batches with a field of their struct row as text."""
    for batch in batches:
        yield batch.append_column("text", batch.column("row").field(field))


def kept_rows(window: int, text: int):
    """mapInArrow function: documents with the last level's answers to row, kept (text), n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(with_text(batches, text)):
            block, n = Block.__new__(Block), batch.num_rows
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, doc = words(data, offsets)
            block.doc, block.first = doc, np.searchsorted(starts, offsets)
            named, whole = local_positions(block, batch.column("answers").to_pylist(), n)
            gone = covered(named, window, doc) | whole[doc]
            raw, texts, sums = data.tobytes(), [], []
            first, n_gone = block.first, np.add.reduceat(np.append(gone, False), block.first[:-1]) if n else np.zeros(0)
            n_words = np.diff(first)
            n_gone = np.where(n_words > 0, n_gone, 0)
            for i in range(n):
                lo, hi = first[i], first[i + 1]
                left = np.flatnonzero(~gone[lo:hi]) + lo
                sums.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])).hexdigest())
                if n_gone[i]:
                    runs = np.split(left, np.flatnonzero(np.diff(left) > 1) + 1) if len(left) else []
                    texts.append(b" ".join(raw[starts[r[0]] : ends[r[-1]]] for r in runs).decode())
                else:
                    texts.append(raw[offsets[i] : offsets[i + 1]].decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(n_words), pa.array(n_gone.astype(np.int64)), pa.array(sums, pa.string())], ["row", "kept", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 20, start: int = 5, bucket_mb: int = 64) -> DataFrame:
    """Removes from docs each word in a window of words that also begins earlier (smaller doc_id, or same row, earlier place).

    Returns the columns of docs, the text as it is left (untouched where nothing was removed, else the stretches left,
    joined by a space), n_words, n_removed and kept_sha256 (of the words left, joined by a space). All rows stay; a
    null text stays null, with 0 words; an empty table gives an empty one. start and bucket_mb decide only the cost.
    """
    lengths = levels(window, start)
    rows = ordered(docs, text, doc_id)
    # every join takes the same columns of the documents, so that they are shuffled once and that exchange is used again
    whole, found, place = rows.select("ord", "key", "row"), None, docs.columns.index(text)
    buckets = n_buckets(docs, bucket_mb)
    for level in range(len(lengths)):
        if found is None:
            asked = rows.select("ord", "key", "text").mapInArrow(tidied(questions(lengths, level, buckets)), ASKED_DDL)
        else:
            asked = whole.join(found, ["ord", "key"]).mapInArrow(tidied(questions(lengths, level, buckets, place)), ASKED_DDL)
        answered = asked.repartition(buckets, "bucket").mapInArrow(tidied(answers(level == len(lengths) - 1, buckets)), ANSWERED_DDL)
        found = answered.repartition(buckets, "bucket").mapInArrow(tidied(gathered), GATHERED_DDL)
    joined = whole.join(found, ["ord", "key"], "left").select("row", "answers")
    schema = joined.select("row").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    out = joined.mapInArrow(tidied(kept_rows(window, place)), schema)
    new = {text: F.when(F.col(f"row.`{text}`").isNotNull(), F.col("kept")), "n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "kept_sha256": F.col("kept_sha256")}
    return overlaid(out, "row", docs.columns, new)
