"""Byte-level BPE by merge replay over the words of a corpus block.

A block's texts are parted by the pattern; its distinct words become one array of byte tokens, and an index leads from
each token pair's rank to the places where the pair stands. Then every merge is applied in rank order, to all its
places at once, and only the neighbours touched get new entries. A word in which a merge brings up a pair of lower
rank is encoded once more by the definition (the lowest rank first, the leftmost on ties), so results are those of
merging word by word. A word that is a token by itself is that token.

Nulls: a null text is empty: no ids, and decodes to no bytes. Unknown ids raise an error. Rows that repeat are
encoded each; an empty table gives none. Lone surrogates can't occur in Spark's strings.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begins, blocks, filled, overlaid, tidied
from .encoders import Flat, Numbers, Pieces, gathered

#: Stands for a pair that doesn't merge: after all ranks.
NONE = np.int32((1 << 31) - 1)
#: Text that one replay takes; distinct words fewer, so memory stays some hundred MB.
REPLAY_BYTES = 6 << 20


class Vocabulary:
    """The tokens of a rank file, to decode with."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.lengths = np.zeros(max(self.rank.values()) + 1, np.int64)
        self.lengths[list(self.rank.values())] = list(map(len, self.rank))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(sorted(self.rank, key=self.rank.get)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


class Ranks(Vocabulary):
    """A rank file, and the rank that two neighbouring tokens merge into."""

    def __init__(self, path: str):
        super().__init__(path)
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the rank file lacks single bytes: {missing[:5]}")
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.bits = len(self.lengths).bit_length()
        keys, merged = array("q"), array("i")
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << self.bits | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it doesn't merge."""
        key = left.astype(np.int64) << self.bits | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def by_definition(self, word: bytes) -> list[int]:
        """The lowest rank first, the leftmost on ties: a heap of pairs, and the neighbours of each part that is left."""
        parts: list = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank, i, 2) for i in range(len(parts) - 1) if (rank := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)

        def enter(i: int) -> None:
            j = after[i]
            if j < len(parts) and (rank := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]) + len(parts[j])))

        while heap:
            rank, i, length = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != length or self.rank.get(parts[i] + parts[j]) != rank:
                continue  # of a part that has changed since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            enter(i)
            if before[i] >= 0:
                enter(before[i])
        return [self.rank[p] for p in parts if p is not None]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has. No word is empty."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(token), np.cumsum(sizes)
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        right[ends - 1], left[ends - sizes] = -1, -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE)
        paired = np.flatnonzero(right >= 0).astype(np.int32)
        rank[paired] = self.pair(token[paired], token[paired + 1])
        odd: list[np.ndarray] = []  # places in words that bring up a lower rank
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            ranks = rank[places]
            at = np.flatnonzero(begins(ranks))
            for r, some in zip(ranks[at].tolist(), np.split(places, at[1:]), strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(some)

        enter(paired)
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r)
            places = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
            places = places[(rank[places] == r) & alive[places]]
            if len(places) > 1:  # of places that chain (a a a), every second from the left
                chained = right[places[:-1]] == places[1:]
                if chained.any():
                    i = np.arange(len(places))
                    first = np.maximum.accumulate(np.where(np.append(False, chained), 0, i))
                    places = places[(i - first) % 2 == 0]
            if not len(places):
                continue
            gone = right[places]
            beyond = right[gone]
            token[places], right[places] = r, beyond
            alive[gone] = False
            rank[gone] = NONE
            some = beyond >= 0
            left[beyond[some]] = places[some]
            before = left[places]
            touched = np.unique(np.concatenate([places, before[before >= 0]]))
            after = right[touched]
            rank[touched] = np.where(after >= 0, self.pair(token[touched], token[np.maximum(after, 0)]), NONE)
            lower = touched[rank[touched] < r]
            if len(lower):
                odd.append(lower)
            enter(touched)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ids, counts = token[alive].astype(np.uint32), np.bincount(word_of[alive], minlength=len(words))
        if odd:
            again = np.unique(word_of[np.concatenate(odd)])
            each = np.split(ids, np.cumsum(counts)[:-1])
            for w in again.tolist():
                each[w] = np.array(self.by_definition(words[w]), np.uint32)
                counts[w] = len(each[w])
            ids = np.concatenate(each)
        return ids, counts

    def encode(self, texts: pa.Array, pattern) -> Flat:
        """The ids of each text."""
        pieces = Pieces(texts, "gap")
        words, parts, sizes = Numbers(), [], []
        for i in range(0, len(pieces.distinct), 100_000):
            for piece in pieces.distinct.slice(i, 100_000).to_pylist():
                found = pattern.findall(" " + piece)
                parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)) if len(found) != 1 else words[found[0]])
                sizes.append(len(found))
        for text in pieces.own:
            found = pattern.findall(text)
            parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            sizes.append(len(found))
        encoded = [w.encode() for w in words]
        del words
        whole = np.fromiter((self.rank.get(w, -1) for w in encoded), np.int64, len(encoded))
        merge, direct = np.flatnonzero(whole < 0), np.flatnonzero(whole >= 0)
        ids, counts = self.replay([encoded[i] for i in merge.tolist()])
        by_word = Flat(np.concatenate([whole[direct].astype(np.uint32), ids]), np.concatenate([np.ones(len(direct), np.int64), counts]))
        place = np.empty(len(encoded), np.int64)
        place[np.concatenate([direct, merge])] = np.arange(len(encoded))
        part = place[np.concatenate([np.atleast_1d(p) for p in parts]).astype(np.int64)] if parts else np.zeros(0, np.int64)
        return by_word.joined(part, np.array(sizes, np.int64)).joined(pieces.order, pieces.counts)


_loaded: dict[tuple, Vocabulary] = {}


def loaded(kind: type, path: str):
    """One per Python worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encoding(path: str, pattern: str):
    """mapInArrow function: row, text to row, n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for batch in filled(batches, "text", REPLAY_BYTES):
            encoded = loaded(Ranks, path).encode(batch.column("text"), compiled)
            for i in range(0, batch.num_rows, 1000):  # ids of some MB at a time
                n = encoded.lengths[i : i + 1000]
                ids = encoded.flat[encoded.starts[i] : encoded.starts[i] + n.sum()]
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n) * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1000), pa.array(n), data], ["row", "n_tokens", "ids"])

    return run


def decoding(path: str):
    """mapInArrow function: row, ids to row, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "ids"):
            texts = [loaded(Vocabulary, path).decode(np.frombuffer(b or b"", "<u4")) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary())], ["row", "decoded"])

    return run


def _rows(df: DataFrame, column: str, alias: str, keep: list[str]) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{column}`").alias(alias))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and ids (binary, little-endian unsigned 32-bit); columns of these names are replaced.

    path: a rank file; pattern: parts the text into words, each a match. It has to begin a match at every single space
    between characters that aren't white space.
    """
    rows = _rows(docs, text, "text", docs.columns)
    out = rows.mapInArrow(tidied(encoding(path, pattern)), rows.select("row").schema.add("n_tokens", "long").add("ids", "binary"))
    return overlaid(out, "row", docs.columns, {"n_tokens": F.col("n_tokens"), "ids": F.col("ids")})


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded (binary: bytes need not be whole characters)."""
    rows = _rows(encoded, ids, "ids", encoded.columns)
    out = rows.mapInArrow(tidied(decoding(path)), rows.select("row").schema.add("decoded", "binary"))
    return overlaid(out, "row", encoded.columns, {"decoded": F.col("decoded")})
