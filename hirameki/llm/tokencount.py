"""Token counts with sentencepiece, by overlap resynchronisation for huge documents.

A huge text is encoded in chunks that overlap, with the offset of each token. Two neighbours are spliced at a place
inside their overlap where both begin a token and where no encoding can have a token across: before a space that
follows another character, in a model none of whose pieces has its space sign after another character (checked when
the model is loaded; other models encode whole texts). The splice is the last such place; where there is none the
overlap is doubled, and a chunk that it takes up entirely is encoded anew at twice its length, so that a text without
such places costs twice what it does at once.

Nulls: a null text is empty: 0 bytes, 0 tokens. Rows that repeat are counted each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, overlaid, tidied

SIGN = "▁"


class Counter:
    """Counts tokens; texts longer than chunk characters by overlapping chunks of so many bytes."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 256):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if not 0 < overlap < chunk:
            raise ValueError("0 < overlap < chunk")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        inner = any(SIGN in p.piece.lstrip(SIGN) for p in model.pieces if p.type in (1, 4))  # normal and user-defined pieces
        self.stable = not inner and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and spec.escape_whitespaces

    def begins(self, data: bytes, start: int, stop: int) -> np.ndarray:
        """Where each token of data[start:stop] begins in data."""
        found = self.library.encode(data[start:stop].decode(), return_type="proto").pieces
        return np.array([p.begin for p in found], np.int64) + start

    def __call__(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if not self.stable or len(t) <= self.chunk]
        found = iter(map(len, self.library.encode(short, num_threads=1)))
        return [self.spliced(t.encode()) if self.stable and len(t) > self.chunk else next(found) for t in texts]

    def spliced(self, data: bytes) -> int:
        n = len(data)

        def cut(at: int) -> int:
            """at, or the end of the character that it would part."""
            while at < n and data[at] & 0xC0 == 0x80:
                at += 1
            return min(at, n)

        def stable_in(start: int, end: int) -> bool:
            """Whether there is a place after start and before end that tokens can't have across."""
            space = data.find(b" ", start + 1, end)
            while 0 <= space and data[space - 1] == 32:
                space = data.find(b" ", space + 1, end)
            return space >= 0

        total, at, from_, end = 0, 0, 0, cut(self.chunk)  # tokens before from_; the current chunk is data[at:end]
        here = self.begins(data, at, end)
        while end < n:
            width = self.overlap
            while True:
                start = cut(max(at, end - width))
                if start <= from_:  # the overlap has taken up the chunk: encode both as one, twice as long
                    end = cut(at + 2 * (end - at))
                    here = self.begins(data, at, end)
                    break
                if not stable_in(start, end):  # nothing to splice at: no need to encode it
                    width *= 2
                    continue
                stop = cut(max(start + self.chunk, end + self.overlap))
                there = self.begins(data, start, stop)
                both = np.intersect1d(here[(here > start) & (here < end)], there)
                place = next((p for p in both[::-1].tolist() if data[p] == 32 and data[p - 1] != 32), None)
                if place is not None:
                    total += int(np.count_nonzero((here >= from_) & (here < place)))
                    at, end, from_, here = start, stop, place, there
                    break
                width *= 2
        return total + int(np.count_nonzero(here >= from_))


_counters: dict[tuple, Counter] = {}


def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One per Python worker."""
    key = (path, chunk, overlap)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def counting(path: str, chunk: int, overlap: int):
    """mapInArrow function: row, text to row, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n = counter(path, chunk, overlap)([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64())], ["row", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = 32_768, overlap: int = 256, limit: int = 4096) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (no begin or end), over_limit (n_tokens > limit); columns of these names are replaced."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(tidied(counting(path, chunk, overlap)), rows.select("row").schema.add("n_tokens", "long"))
    n_bytes = F.coalesce(F.octet_length(f"row.`{text}`"), F.lit(0)).cast("long")
    return overlaid(counted, "row", docs.columns, {"n_bytes": n_bytes, "n_tokens": F.col("n_tokens"), "over_limit": F.col("n_tokens") > limit})
