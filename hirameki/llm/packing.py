"""Packing of examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. An example beyond the limits is cut into full
pieces first; what is left of it is a vector of the three sizes. A sequence takes, again and again, the piece that
fits and whose vector has the largest dot product with the room left (each as a share of its limit), and where none
fits, a cut of the piece with the largest product. Every task packs its own rows, some thousand pieces at a time,
so nothing is shuffled and only a task's last sequence is left open.

Nulls: a null text is empty, its example the end id alone. Rows that repeat are packed each. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import filled, tidied
from .encoders import ENCODED_BYTES, encoder

PLACED_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
PLACED = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset")])
#: Pieces that wait at a time, and so many are left to wait while more come.
WAITING, LEFT = 1024, 256


class Packer:
    """Takes examples, gives placements (example, start, length, loss, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are 1 at least")
        self.max = (tokens, segments, loss)
        self.sequence, self.placed = 0, []
        self.waiting: list[tuple] = []  # example, start, end, first loss-bearing token

    def longest(self, start: int, end: int, first_loss: int, tokens: int, loss: int) -> int:
        """Tokens from start that stay within both limits."""
        return min(end - start, tokens, max(0, first_loss - start) + loss)

    def add(self, example, length: int, first_loss: int) -> None:
        """An example whose tokens from first_loss on bear loss."""
        tokens, _, loss = self.max
        start = 0
        while (n := self.longest(start, length, first_loss, tokens, loss)) < length - start:
            self.placed.append((example, start, n, max(0, start + n - max(start, first_loss)), self.sequence, 0))
            self.sequence += 1
            start += n
        if start < length:
            self.waiting.append((example, start, length, first_loss))
        if len(self.waiting) >= WAITING:
            self.pack(LEFT)

    def pack(self, left: int = 0) -> None:
        """Fills sequences until no more than so many pieces wait."""
        items = self.waiting
        start, end, first_loss = (np.array([x[k] for x in items], np.int64) for k in (1, 2, 3))
        size, loss = end - start, end - np.maximum(start, np.minimum(first_loss, end))  # 0: placed as a whole
        max_tokens, max_segments, max_loss = self.max
        n_open = len(items)
        while n_open > left:
            tokens, segments, losses, offset = max_tokens, max_segments, max_loss, 0
            while n_open and tokens and segments:
                # each size and each room as a share of its limit; a piece is one segment
                score = size * (tokens / max_tokens**2) + loss * (losses / max_loss**2) + segments / max_segments**2
                fits = (size <= tokens) & (loss <= losses) & (size > 0)
                i = int(np.argmax(np.where(fits, score, -1)))
                n = int(size[i])
                if not fits[i]:
                    i = int(np.argmax(np.where(size > 0, score, -1)))
                    n = self.longest(int(start[i]), int(end[i]), int(first_loss[i]), tokens, losses)
                    if n < 1:
                        break
                s = int(start[i])
                bears = max(0, s + n - max(s, int(first_loss[i])))
                self.placed.append((items[i][0], s, n, bears, self.sequence, offset))
                tokens, segments, losses, offset = tokens - n, segments - 1, losses - bears, offset + n
                start[i] += n
                size[i] -= n
                loss[i] -= bears
                n_open -= not size[i]
            self.sequence += 1
        open_ = size > 0
        self.waiting = [(items[i][0], int(start[i]), int(end[i]), int(first_loss[i])) for i in np.flatnonzero(open_)]


def rows(packer: Packer, first_sequence: int) -> Iterator[pa.RecordBatch]:
    placed, packer.placed = packer.placed, []
    if placed:
        doc_id, ids = [p[0][0] for p in placed], [p[0][1] for p in placed]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc_id, pa.int64()), pa.array([p[1] for p in placed], pa.int64()), pa.array([p[2] for p in placed], pa.int64()),
                pa.array([x[p[1] : p[1] + p[2]].tobytes() for x, p in zip(ids, placed, strict=True)], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([p[3] for p in placed], pa.int64()), pa.array([first_sequence + p[4] for p in placed], pa.int64()), pa.array([p[5] for p in placed], pa.int64()),
            ],
            schema=PLACED,
        )


def prompts(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Of each stretch of flat, how many ids there are up to the first of those that hold the mark, with it; 0 if none does."""
    at = np.append(np.flatnonzero(holds[flat]), len(flat))
    first = at[np.searchsorted(at, starts)]
    return np.where(first < starts + lengths, first - starts + 1, 0)


def packing(path: str, rule: str, end_id: int, tokens: int, segments: int, loss: int, has_loss: bool, prompt: str | None):
    """mapInArrow function: doc_id, text (and loss_from: so many ids bear no loss) to PLACED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path, rule).encode, Packer(tokens, segments, loss)
        first = TaskContext.get().partitionId() << 40
        for batch in filled(batches, "text", ENCODED_BYTES):
            doc_ids, encoded = batch.column("doc_id").to_pylist(), encode(batch.column("text"))
            if has_loss:
                froms = batch.column("loss_from").to_pylist()
            else:
                froms = [0] * len(doc_ids) if prompt is None else prompts(encoded.flat, encoded.starts, encoded.lengths, encoder(path, rule).holding(prompt)).tolist()
            for doc_id, at, n, from_ in zip(doc_ids, encoded.starts.tolist(), encoded.lengths.tolist(), froms, strict=True):
                packer.add((doc_id, np.append(encoded.flat[at : at + n], np.uint32(end_id))), n + 1, from_ or 0)
            yield from rows(packer, first)
        packer.pack()
        yield from rows(packer, first)

    return run


def pack(docs: DataFrame, path: str, rule: str = "gap", text: str = "text", doc_id: str = "doc_id", end_id: int = 0, tokens: int = 1024, segments: int = 256, loss: int | None = None, loss_from: str | None = None, prompt: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start (its example's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with the end id), loss_tokens, sequence_id, offset (in the sequence, gapless from 0).

    path: a file of the tokenizers library, rule: see encoders. loss_from names a column with the number of leading
    tokens that bear no loss (an instruction's prompt; null: 0). prompt: a string instead; the ids up to the first that
    holds it are the prompt, and there is none where no id does. Without both all tokens bear loss. Ties go to the piece
    that came first. A text of any length is cut; only its ids are held at once.
    """
    from pyspark.sql import functions as F

    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    if loss_from:
        columns.append(F.col(loss_from).cast("long").alias("loss_from"))
    return docs.select(*columns).mapInArrow(tidied(packing(path, rule, end_id, tokens, segments, loss or tokens, bool(loss_from), prompt)), PLACED_DDL)
