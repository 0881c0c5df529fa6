"""Line dedup by a deletion-neighbourhood join.

A line (without white space at its ends; blank ones don't count) goes if an earlier line equals it, or, from min_chars
code points on, is within the edit bound (one insertion, deletion or substitution by default). Earlier is by doc_id, then
place; the earliest stays.

Two lines one edit apart become equal when each loses the right character: every line emits all its variants with one
character less as hashed keys, tagged with the place (equal key and place: a substitution) or not (equal to a whole
line: an insertion). Equal keys are joined, the pair with the earliest line is verified by edit distance. As most
lines have no neighbour, stretches are deleted first: a line of length m is cut in 2, then 16, then 64 stretches, and
only lines that equal another distinct line but for one stretch go on; an edit lies in one stretch, so none is lost.

The first level runs over all lines, packed by block and bucket as each block's distinct lines, so a line that a third
of all documents share travels once per block. The lines that survive it are few and are one small table.

Nulls: a null text has no lines and stays null; a null doc_id comes after all numbers. Rows that share a doc_id are
ordered by a hash of their text; equal rows get equal results. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, IS_SPACE, Rolling, begins, blocks, byte_table, mixed, n_buckets, ordered, overlaid, result, spans, stretch_hashes, text_bytes, tidied, written
from .exchange import ANSWER, ANSWERED_DDL, ASKED_DDL, GATHERED_DDL, QUESTION, answer_rows, asked_rows, gathered, known_rows, read_asked

#: A position is twice the line's number, plus one where it says that the line goes on to the next level.
EQUAL, ON = 0, 1
IS_BREAK = byte_table("\n")


class Lines:
    """Lines of a block's texts: bytes from start to end without white space at the ends, number in their text, hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        starts, ends, doc = spans(data, offsets, IS_BREAK)
        dark = np.append(0, np.cumsum(~IS_SPACE[data]))
        some = dark[ends] > dark[starts]
        starts, ends, doc = starts[some], ends[some], doc[some]
        breaks = np.append(0, np.cumsum(data == 10))
        self.no = (breaks[starts] - breaks[offsets[doc]]).astype(np.int64)
        places = np.flatnonzero(~IS_SPACE[data])
        self.start, self.end = places[dark[starts]], places[dark[ends] - 1] + 1
        self.doc, self.data = doc, data
        self.h, self.g = (stretch_hashes(data, self.start, self.end, b) for b in BASES)
        lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.first_char, self.end_char = lead[self.start], lead[self.end]  # in characters
        self.n_docs = len(offsets) - 1


def stretch_keys(roll: Rolling, start: np.ndarray, end: np.ndarray, stretches: int) -> np.ndarray:
    """For each line, the hashes of what is left without one stretch, as the shorter and as the longer line of a pair."""
    out = []
    for longer in (0, 1):
        m = end - start - longer
        for i in range(stretches):
            a, b = i * m // stretches, (i + 1) * m // stretches
            head, tail = roll.of(start, start + a), roll.of(end - (m - b), end)
            out.append(mixed(head * np.uint64(BASES[0]) ^ mixed(tail + m.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(i))))
    return np.stack(out, axis=1)


def segment_keys(roll: Rolling, start: np.ndarray, end: np.ndarray, edits: int) -> np.ndarray:
    """For each line, the hashes of edits + 1 segments as the shorter of a pair, and of what may equal them as the longer.

    Of two lines within the bound one segment of the shorter is unchanged in the longer, shifted by the bound at most.
    """
    out, parts = [], edits + 1
    for shorter in range(parts):
        m = end - start - shorter
        for i in range(parts):
            a, b = start + i * m // parts, start + (i + 1) * m // parts
            for shift in range(-edits, edits + 1):
                lo, hi = np.clip(a + shift, start, end), np.clip(b + shift, start, end)
                out.append(mixed(roll.of(lo, hi) + m.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(i)))
    return np.stack(out, axis=1)


def questions(min_chars: int, buckets: int, edits: int):
    """mapInArrow function: ord, key, text to rows of the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ords, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
            x = Lines(batch.column("text"))
            o, k = ords[x.doc], keys[x.doc]
            order = np.lexsort((x.no, k, o, x.g, x.h))
            new = begins(x.h[order], x.g[order])
            first = order[np.flatnonzero(new)]
            firsts = first[np.cumsum(new) - 1]
            same_row = (o[order] == o[firsts]) & (k[order] == k[firsts]) & (x.no[order] == x.no[firsts])
            gone = order[~same_row]
            said = np.zeros(len(gone), QUESTION)
            said["doc"], said["pos"] = x.doc[gone], 2 * x.no[gone] + EQUAL
            yield from known_rows(said, ords, keys)
            e = np.zeros(len(first), QUESTION)
            e["h"], e["g"], e["doc"], e["pos"] = x.h[first], x.g[first] & np.uint64(0xFFFFFFFF), x.doc[first], 2 * x.no[first] + EQUAL
            long = first[x.end_char[first] - x.first_char[first] >= min_chars]
            chars = np.frombuffer(x.data.tobytes().decode().encode("utf-32-le"), "<u4")
            roll = Rolling(chars)
            shared = stretch_keys(roll, x.first_char[long], x.end_char[long], 2) if edits == 1 else segment_keys(roll, x.first_char[long], x.end_char[long], edits) if edits else np.zeros((len(long), 0), np.uint64)
            f, each = np.zeros(shared.size, QUESTION), shared.shape[1]
            f["h"], f["g"], f["doc"], f["pos"], f["more"] = shared.reshape(-1), np.repeat(x.g[long] & np.uint64(0xFFFFFFFF), each), np.repeat(x.doc[long], each), np.repeat(2 * x.no[long] + ON, each), 1
            e = np.concatenate([e, f])
            yield from asked_rows(e, ords, keys, ((e["h"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64))

    return run


def answers(buckets: int):
    """mapInArrow function over whole buckets: which lines have an earlier equal, and which share a half with another distinct line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, (h, g, o, k, pos, half) = read_asked(batches)
        if len(h):
            order = np.lexsort((pos, k, o, g, h, half))
            h, g, o, k, pos, half = (c[order] for c in (h, g, o, k, pos, half))
            new = begins(half, h)  # of halves, a group has all lines with it
            line = begins(half, h, g)
            group, lines = np.cumsum(new) - 1, np.cumsum(line) - 1
            first = np.flatnonzero(line)[lines]
            later = (o != o[first]) | (k != k[first]) | (pos != pos[first])
            several = np.bincount(group, line)[group] > 1
            yes = np.where(half == 1, several, later)
            x = np.zeros(int(yes.sum()), ANSWER)
            x["ord"], x["key"], x["pos"] = o[yes], k[yes], pos[yes]
            found.append(x)
        yield from answer_rows(found, buckets)

    return run


def going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: documents with answers to their lines that go on: ord, key, no, id (hash), line."""
    for batch in blocks(batches):
        x, blobs = Lines(batch.column("text")), batch.column("answers").to_pylist()
        lo = np.searchsorted(x.doc, np.arange(x.n_docs + 1))
        picked = []
        for i, blob in enumerate(blobs):
            pos = np.frombuffer(blob, "<u4")
            on = np.setdiff1d(pos[pos % 2 == ON] // 2, pos[pos % 2 == EQUAL] // 2)
            picked.append(lo[i] + np.searchsorted(x.no[lo[i] : lo[i + 1]], on))
        at = np.concatenate(picked)
        raw = x.data.tobytes()
        lines = [raw[a:b].decode() for a, b in zip(x.start[at].tolist(), x.end[at].tolist(), strict=True)]
        ords, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ords[x.doc[at]]), pa.array(keys[x.doc[at]]), pa.array(x.no[at].astype(np.int64)), pa.array(x.h[at].view(np.int64)), pa.array(lines, pa.string())], ["ord", "key", "no", "id", "line"]
        )


def by_line(column: pa.Array) -> tuple[Rolling, np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return Rolling(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")), np.append(0, ends[:-1]), ends


def stretching(stretches: int):
    """mapInArrow function: id, line to k, id for every stretch deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "line", 1 << 20):
            keys = stretch_keys(*by_line(batch.column("line")), stretches)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), keys.shape[1]))], ["k", "id"])

    return run


#: Roles of a line in a key: it loses more characters than the other line of a pair, fewer, or as many.
MORE, FEWER, SAME = 0, 1, 2
VARIANTS_DDL = "kind int, role int, k long, id long"


def variant_rows(kind: int, role: int, k: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), role, np.int32)), pa.array(k.view(np.int64)), pa.array(ids)], ["kind", "role", "k", "id"])


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: id, line to the keys of the line and of all its variants with one character less."""
    for batch in blocks(batches, "line", 1 << 20):
        roll, start, end = by_line(batch.column("line"))
        n = end - start
        line = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(line))
        whole = combined(roll, start[line], place, end[line])
        tagged = mixed(whole ^ mixed((place - start[line]).astype(np.uint64) + np.uint64(1)))
        ids = batch.column("id").to_numpy()
        yield variant_rows(11, SAME, tagged, ids[line])
        yield variant_rows(10, MORE, whole, ids[line])
        yield variant_rows(10, FEWER, combined(roll, start, end, end), ids)


def deletions(m: int, n: int, rows: int = 100_000) -> Iterator[np.ndarray]:
    """All ways to choose n of m places, ascending, some rows at a time."""
    if n == 0:
        yield np.zeros((1, 0), np.int64)
    elif n == 1:
        yield from np.split(np.arange(m)[:, None], range(rows, m, rows))
    else:
        for first in range(0, m - n + 1):
            for rest in deletions(m - first - 1, n - 1, rows):
                yield np.concatenate([np.full((len(rest), 1), first), rest + first + 1], axis=1)


def variants_within(edits: int):
    """mapInArrow function: id, line to the keys of all variants with up to so many characters less.

    Two lines that lose a and b characters and are equal then are within a + b edits, and each character that both lose
    at the same gap saves one (a substitution). So a pair's key holds the gaps of a + b - edits of them: equal keys of
    lines in the two roles are within the bound.
    """

    def of_line(line: str, id_: int) -> Iterator[pa.RecordBatch]:
        points = np.frombuffer(line.encode("utf-32-le"), "<u4")
        roll, m = Rolling(points), len(points)
        back = [np.uint64(pow(BASES[0], -j, 1 << 64)) for j in range(edits + 1)]
        for a in range(min(edits, m) + 1):
            for places in deletions(m, a):
                edges = np.concatenate([np.full((len(places), 1), -1), places, np.full((len(places), 1), m)], axis=1)
                total = np.zeros(len(places), np.uint64)
                for j in range(a + 1):
                    total += (roll.sums[edges[:, j + 1]] - roll.sums[edges[:, j] + 1]) * back[j]
                left = mixed(total + np.uint64(m - a))
                gaps = (places - np.arange(a)).astype(np.uint64)
                for b in range(edits + 1):
                    tags = max(0, a + b - edits)
                    if tags > min(a, b):
                        continue
                    for some in combinations(range(a), tags):
                        tag = np.zeros(len(places), np.uint64)
                        for c in some:
                            tag = mixed(tag * np.uint64(BASES[1]) + gaps[:, c] + np.uint64(1))
                        yield variant_rows(10 * max(a, b) + min(a, b), MORE if a > b else FEWER if a < b else SAME, mixed(left ^ tag), np.full(len(places), id_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, id_ in zip(batch.column("line").to_pylist(), batch.column("id").to_pylist(), strict=True):
                yield from of_line(line, id_)

    return run


def combined(roll: Rolling, start: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the characters from start to end without the one at place (place = end: with all)."""
    after = np.minimum(place + 1, end)
    head = (roll.sums[place] - roll.sums[start]) * roll.back[start]
    tail = (roll.sums[end] - roll.sums[after]) * roll.back[start] * np.where(place < end, roll.back[1], np.uint64(1))
    return mixed(head + tail + (end - start - (place < end)).astype(np.uint64))


def one_edit(a: str, b: str) -> bool:
    """Whether the edit distance is one at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is edits at most: the table of distances, in a band of that width around the diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            new[j] = i if j == 0 else min(row.get(j - 1, edits + 1) + (a[i - 1] != b[j - 1]), row.get(j, edits + 1) + 1, new.get(j - 1, edits + 1) + 1)
        row = new
        if min(row.values()) > edits:
            return False
    return row.get(len(b), edits + 1) <= edits


def verifying(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("line").to_pylist(), batch.column("first_line").to_pylist(), strict=True)
            ok = [one_edit(a, b) if edits == 1 else within(a, b, edits) for a, b in pairs]
            yield batch.select(["ord", "key", "no"]).filter(pa.array(ok, pa.bool_()))

    return run


def repeated(keyed: DataFrame, *by: str) -> DataFrame:
    """The rows whose keys come with more than one id."""
    several = keyed.groupBy(*by).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select(*by)
    return keyed.join(several, list(by), "left_semi")


def removed_lines(keyed: DataFrame, min_chars: int, bucket_mb: int, edits: int) -> DataFrame:
    """keyed: ord, key, text. ord, key, gone: the numbers of lines that have an earlier line within the bound; only documents with some."""
    if edits < 0 or edits > 9:
        raise ValueError("edits is 0 to 9")
    buckets = n_buckets(keyed, bucket_mb)
    asked = keyed.mapInArrow(tidied(questions(max(min_chars, edits + 1), buckets, edits)), ASKED_DDL)
    answered = asked.repartition(buckets, "bucket").mapInArrow(tidied(answers(buckets)), ANSWERED_DDL)
    found, _ = written(answered.repartition(buckets, "bucket").mapInArrow(tidied(gathered), GATHERED_DDL))
    # positions are unsigned 32-bit; the lowest bit of each tells whether its line goes on
    on = found.mapInArrow(tidied(any_on), GATHERED_DDL)
    lines, _ = written(keyed.join(on, ["ord", "key"]).mapInArrow(tidied(going_on), "ord long, key long, no long, id long, line string").dropDuplicates(["ord", "key", "no"]))
    for stretches in (16, 64) if edits == 1 else ():
        some = repeated(lines.select("id", "line").mapInArrow(tidied(stretching(stretches)), "k long, id long"), "k").select("id").distinct()
        lines, _ = written(lines.join(some, "id", "left_semi"))
    names = lines.select("id", F.struct("ord", "key", "no").alias("at"), "line")
    made = lines.select("id", "line").mapInArrow(tidied(variants if edits == 1 else variants_within(edits)), VARIANTS_DDL)
    keys, _ = written(repeated(made, "kind", "k").join(names.select("id", "at"), "id"))
    firsts = keys.groupBy("kind", "k", F.when(F.col("role") == SAME, SAME).otherwise(1 - F.col("role")).alias("role")).agg(F.min("at").alias("first"))
    earliest = keys.join(firsts, ["kind", "k", "role"]).where("first < at").groupBy("at").agg(F.min("first").alias("first"))
    texts = names.select("at", "line")
    checked = earliest.join(texts, "at").join(texts.select(F.col("at").alias("first"), F.col("line").alias("first_line")), "first")
    near = checked.select("at.ord", "at.key", "at.no", "line", "first_line").mapInArrow(tidied(verifying(edits)), "ord long, key long, no long")
    near = near.groupBy("ord", "key").agg(F.collect_set("no").alias("near"))
    return found.join(near, ["ord", "key"], "full").mapInArrow(tidied(all_gone), "ord long, key long, gone array<long>").where(F.size("gone") > 0)


def any_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = [bool((np.frombuffer(b, "<u4") % 2 == ON).any()) for b in batch.column("answers").to_pylist()]
        yield batch.filter(pa.array(some, pa.bool_()))


def all_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for blob, near in zip(batch.column("answers").to_pylist(), batch.column("near").to_pylist(), strict=True):
            pos = np.frombuffer(blob or b"", "<u4")
            gone.append(sorted({*(pos[pos % 2 == EQUAL] // 2).tolist(), *(near or ())}))
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), pa.array(gone, pa.list_(pa.int64()))], ["ord", "key", "gone"])


def n_lines(text) -> object:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")).cast("long")


def find_duplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, edits: int = 1, bucket_mb: int = 64) -> DataFrame:
    """docs with n_lines (not blank), n_removed and removed (numbers of the lines that go, from 0, ascending); such columns are replaced.

    min_chars: shorter lines go only if they equal an earlier one. edits: the bound; one is the main path, as a line of m
    characters has some m ** edits variants (lines that share no segment with another distinct line make none).
    """
    rows = ordered(docs, text, doc_id).withColumn("n_lines", n_lines(F.col("text")))
    gone = result(lambda: removed_lines(rows.select("ord", "key", "text"), min_chars, bucket_mb, edits))
    joined = rows.drop("text").join(gone, ["ord", "key"], "left")
    removed = F.coalesce("gone", F.array().cast("array<bigint>"))
    return overlaid(joined, "row", docs.columns, {"n_lines": F.col("n_lines"), "n_removed": F.size(removed).cast("long"), "removed": removed})


def drop_duplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, edits: int = 1, bucket_mb: int = 64) -> DataFrame:
    """docs without the lines that go; all rows stay, if need be with an empty text."""
    rows = ordered(docs, text, doc_id)
    gone = result(lambda: removed_lines(rows.select("ord", "key", "text"), min_chars, bucket_mb, edits))
    joined = rows.drop("text").join(gone, ["ord", "key"], "left")
    at = F.col(f"row.`{text}`")
    left = F.array_join(F.transform(F.filter(F.transform(F.split(at, "\n"), lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))), lambda s: ~F.array_contains("gone", s["i"])), lambda s: s["x"]), "\n")
    return overlaid(joined, "row", docs.columns, {text: F.when(F.col("gone").isNull(), at).otherwise(left)})
