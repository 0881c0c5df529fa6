"""Encoding with the tokenizers library, each distinct part of a block of texts once.

A text is cut only where the tokenizer's own pattern always begins anew, so the ids of the pieces, joined, are those
of the whole text. Two rules are known: "gap" (a single space between two characters that aren't white space begins a
match: byte-level patterns such as ` ?\\p{L}+`) and "drop" (the pattern never matches white space, which parts all matches).
A text in which a space has white space or nothing beside it is not cut by the first rule.

A piece that ends in punctuation after a letter or digit is two parts, as both patterns begin a match there, and a
line break between two characters that aren't white space is a part of its own ("gap") or a space ("drop"). Parts of
letters alone are encoded many in one text, where the vocabulary shows which ids begin (or end) a part; if the count
of those isn't that of the parts, they are encoded one by one. Cutting and finding what is distinct is Arrow's work.
"""

from __future__ import annotations

import os
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time: the more, the more pieces come again, and the more memory they take.
ENCODED_BYTES = 16 << 20
#: A space beside white space, or at an end (Unicode's white space, and the four separators that some libraries count).
UNSURE = r"[\s\v\x1c-\x1f\x{85}\p{Z}] | [\s\v\x1c-\x1f\x{85}\p{Z}]|^ | $|\A | \z"
#: What a piece may end in, and the letters and digits before it.
MARKS, BEFORE = ".,;:!?", "A-Za-z0-9À-ÖØ-öø-ɏ"


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after the other."""
    ends = np.cumsum(lengths)
    small = np.int32 if len(flat) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
    at = np.repeat((starts - ends + lengths).astype(small), lengths)
    at += np.arange(len(at), dtype=small)
    return flat[at]


class Flat:
    """Arrays of integers, read as stretches of one array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, lists: list[list[int]]) -> Flat:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls(np.fromiter((x for ids in lists for x in ids), np.uint32, int(lengths.sum())), lengths)

    def __add__(self, other: Flat) -> Flat:
        return Flat(np.concatenate([self.flat, other.flat]), np.concatenate([self.lengths, other.lengths]))

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.starts[which], self.lengths[which])

    def joined(self, which: np.ndarray, counts: np.ndarray) -> Flat:
        """Stretches of which, so many in each."""
        ends = np.append(0, np.cumsum(self.lengths[which]))[np.append(0, np.cumsum(counts))]
        return Flat(self[which], np.diff(ends))


class Numbers(defaultdict):
    """Numbers keys from 0 in the order in which they come."""

    def __init__(self):
        super().__init__(count().__next__)


class Pieces:
    """The pieces of a block of texts: distinct (after the space that each but a text's first begins with by "gap"),
    order (numbers of distinct, and from len(distinct) on the texts' own), counts by text, and the texts' own pieces
    (by "gap" a text's first piece, or all of a text that isn't cut; by "drop" there are none)."""

    def __init__(self, texts: pa.Array, rule: str):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, UNSURE) if rule == "gap" else pa.array([False] * len(texts), pa.bool_())
        if rule == "drop":
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(pc.if_else(whole, pa.scalar("", pa.large_string()), texts), " ")
        values, offsets = lists.values, np.asarray(lists.offsets).astype(np.int64)
        coded = values.dictionary_encode()
        self.distinct, self.own = coded.dictionary, []
        self.order, self.counts = np.array(coded.indices, np.int64), np.diff(offsets)
        if rule == "gap":
            first = values.take(pa.array(offsets[:-1]))
            self.own = pc.if_else(whole, texts, first).to_pylist()
            self.order[offsets[:-1]] = len(self.distinct) + np.arange(len(texts))


class PieceEncoder:
    """Ids of texts by a file of the tokenizers library."""

    def __init__(self, path: str, rule: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if rule not in ("gap", "drop"):
            raise ValueError("rule is gap or drop")
        self.library, self.rule = Tokenizer.from_file(path), rule
        self.space = " " if rule == "gap" else ""
        self.marks: dict[str, np.ndarray] = {}
        names = self.library.get_vocab()
        self.edge = np.zeros(max(names.values()) + 1, bool)  # ids that begin a part ("gap": by its space) or end it ("drop")
        self.line_break = self.direct(["a\nb"])[0][1]
        self.edge[[i for name, i in names.items() if (name.startswith("\u0120") if rule == "gap" else name.endswith("</w>"))]] = True

    def holding(self, mark: str) -> np.ndarray:
        """By id, whether its text holds the mark."""
        if mark not in self.marks:
            n = self.library.get_vocab_size()
            self.marks[mark] = np.array([mark in t for t in self.library.decode_batch([[i] for i in range(n)], skip_special_tokens=False)], bool)
        return self.marks[mark]

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, parts: list[str], space: str) -> Flat:
        """Ids of parts of letters, each after a space (or none: then by "gap" line breaks part them)."""
        between = "\n" if self.rule == "gap" and not space else " "
        ids = np.array(self.direct([space + between.join(parts)])[0], np.uint32)
        if between == "\n":
            edges = np.append(-1, np.flatnonzero(ids == self.line_break))
            if len(edges) == len(parts):
                return Flat(ids[ids != self.line_break], np.diff(np.append(edges, len(ids))) - 1)
        else:
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) == len(parts):
                return Flat(ids, np.diff(np.append(edges, len(ids)) if space else np.append(-1, edges)))
        return Flat.of(self.direct([space + p for p in parts]))

    def pool(self, parts: pa.Array, space: str) -> Flat:
        """Ids of distinct parts, each after space."""
        letters = np.asarray(pc.utf8_is_alpha(parts))
        plain, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        found = [Flat.of(self.direct([space + p for p in parts.take(pa.array(other)).to_pylist()]))]
        found += [self.together(parts.take(pa.array(plain[i : i + 10_000])).to_pylist(), space) for i in range(0, len(plain), 10_000)]
        found = Flat(np.concatenate([f.flat for f in found]), np.concatenate([f.lengths for f in found]))
        back = np.argsort(np.concatenate([other, plain]))
        return Flat(found[back], found.lengths[back])

    def parts(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each piece what comes before its closing marks, and these (null: none)."""
        head = pc.utf8_rtrim(pieces, MARKS)
        cut = pc.and_(pc.less(pc.binary_length(head), pc.binary_length(pieces)), pc.match_substring_regex(head, f"[{BEFORE}]\\z"))
        tail = pc.replace_substring_regex(pieces, rf"(?s)^.*[{BEFORE}]", "")
        return pc.if_else(cut, head, pieces), pc.if_else(cut, tail, pa.scalar(None, tail.type))

    def encode(self, texts: pa.Array) -> Flat:
        """The ids of each text as unsigned 32-bit integers."""
        pieces = Pieces(texts, self.rule)
        n, none = len(pieces.distinct), pa.scalar(None, pa.large_string())
        words, two = [(pieces.distinct, self.space)], None
        if self.rule == "gap":
            lines = pc.extract_regex(pieces.distinct, r"\A(?P<a>[^\s\v\x1c-\x1f\x{85}\p{Z}]+)\n(?P<b>[^\s\v\x1c-\x1f\x{85}\p{Z}]+)\z")
            two = lines.is_valid()  # a line break between two words
            words = [(pc.if_else(two, pc.struct_field(lines, [0]), pieces.distinct), " "), (pc.if_else(two, pc.struct_field(lines, [1]), none), "")]
        columns, by_part = [], Flat.of([[], self.direct(["\n"])[0]])
        for column, space in words:
            for values, before in zip(self.parts(column), (space, ""), strict=True):
                coded = values.dictionary_encode()
                number = np.asarray(pc.fill_null(pc.add(coded.indices.cast(pa.int64()), len(by_part.lengths)), 0))  # 0: an empty part
                by_part = by_part + self.pool(coded.dictionary, before)
                columns.append(number)
        if two is not None:
            columns.insert(2, np.asarray(two).astype(np.int64))  # 1: the line break
        by_piece = by_part.joined(np.stack(columns, axis=1).reshape(-1), np.full(n, len(columns))) + Flat.of(self.direct(pieces.own))
        return by_piece.joined(pieces.order, pieces.counts)


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, rule: str) -> PieceEncoder:
    """One per Python worker."""
    if (path, rule) not in _encoders:
        _encoders[path, rule] = PieceEncoder(path, rule)
    return _encoders[path, rule]
