"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

From a bounded sample, centred rotations are learned under which the signs of a vector's components are bits that keep
its direction (iterative quantisation: alternate between signs and the rotation that fits them best); each bit is cut
near its median, so that half of the vectors have it however far the vectors lie from the origin. Of sampled vectors
that are near one another only one counts: else the medians would cut through a group that holds much of the sample.
A code is the bits of several rotations. A table's key is a substring of the code: the bits are shuffled and cut into substrings, shuffled
again for more. Two vectors meet if any key is equal.

How many bits a key has and how many tables there are follows from the number of vectors, and from pairs made of the
sample that are just at the threshold: as many tables as bring the recall asked for of these pairs together.

Two vectors that meet are compared by their codes first. What travels to the tables are ids and codes; only vectors
that have in a bucket another one whose code isn't too far go on to it, with their components, and pairs are compared
by cosine in double precision, so no link below the threshold is ever given. A pair counts in the first table where it
meets.

Equal vectors are one node with a count. A bucket beyond a block's size is dealt to several tasks: each takes one
block of its members and streams all members past it. What leaves a task are counts by node and the edges of a
spanning forest of the links found, so results stay as long as the input, however large a group is.

Nulls: vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing;
such a row is its own component (null without an id) and kept. Vectors of each length have codes of their own and are
compared among themselves. Rows that share an id are one vertex whose links add up, and never link with each other by
different vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, mixed, result, tidied, written
from .components import components

#: Members of a bucket that one task holds.
BLOCK = 4096
#: Bits of a code and of one rotation, at most; 64-bit words of a code.
BITS, ROTATION, WORDS = 256, 64, 4
#: What a member costs in one more table, in comparisons of two codes.
ROW_COST = 64
#: Tables, at most: for vectors that would need more, keys get shorter.
MOST_TABLES = 1024
#: Pairs just at the threshold that are made of the sample, of each of two kinds.
MADE = 2000


def usable(column: pa.Array, kind: str) -> list[bytes | None]:
    """The components of each vector; None where a vector can't be compared."""
    found = []
    for x in column:
        v = None if not x.is_valid else x.values
        a = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False)
        wide = None if a is None else a.astype(np.float64)
        found.append(a.astype(kind).tobytes() if a is not None and np.isfinite(wide).all() and np.isfinite(s := float(wide @ wide)) and s > 0 else None)
    return found


def preparing(kind: str):
    """mapInArrow function: id, vector to id, one, two (hashes of the vector), vec (components), null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [v if v is not None and has else None for v, has in zip(usable(batch.column("vector"), kind), batch.column("id").is_valid().to_pylist(), strict=True)]
            sums = [[0, 0] if v is None else hashes(v, kind) for v in vec]
            one, two = np.array(sums, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(one), pa.array(two), pa.array(vec, pa.binary())], ["id", "one", "two", "vec"])

    return run


def hashes(vec: bytes, kind: str) -> list[int]:
    x = np.frombuffer(vec, kind.replace("f", "u")).astype(np.uint64)
    at = np.arange(1, len(x) + 1, dtype=np.uint64)
    return [int(mixed(x ^ (at * np.uint64(b))).sum(dtype=np.uint64)) for b in BASES]


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that very large and small components don't overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Coder:
    """Projections and cuts that make codes of vectors of one length, the bits of each table's key, and how far codes of a link may be apart."""

    projection: np.ndarray
    cuts: np.ndarray
    tables: np.ndarray
    apart: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.projection > self.cuts

    def masks(self) -> np.ndarray:
        """Each table's bits, as words of a code."""
        bits = np.zeros((len(self.tables), self.projection.shape[1]), bool)
        np.put_along_axis(bits, self.tables, True, axis=1)
        return packed(bits)

    def keys(self, bits: np.ndarray, table: int) -> np.ndarray:
        """64-bit keys, apart for each table and vector length."""
        salt = mixed(np.array([table * 1_000_003 + len(self.projection)], np.uint64))
        powers = np.uint64(1) << np.arange(self.tables.shape[1], dtype=np.uint64)
        return mixed(bits[:, self.tables[table]].astype(np.uint64) @ powers + salt)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    out = np.zeros((len(bits), WORDS * 8), np.uint8)
    some = np.packbits(bits, axis=1, bitorder="little")
    out[:, : some.shape[1]] = some
    return out.view("<u8")


def thinned(sample: np.ndarray, least: float, step: int = 1024) -> np.ndarray:
    """The vectors that have no earlier kept one at cosine least or more."""
    kept: list[np.ndarray] = []
    for i in range(0, len(sample), step):
        x = sample[i : i + step].astype(np.float32)
        gone = np.zeros(len(x), bool)
        for k in kept:
            gone |= (x @ k.T >= least).any(axis=1)
        x = x[~gone]
        near, gone = x @ x.T >= least, np.zeros(len(x), bool)
        for j in range(len(x)):
            if not gone[j]:
                gone[j + 1 :] |= near[j, j + 1 :]
        kept.append(x[~gone])
    return np.concatenate(kept).astype(np.float64)


def middle(values: np.ndarray) -> np.ndarray:
    """Of each column, the middle of the widest gap that begins in its third fifth."""
    values = np.sort(values, axis=0)
    n = len(values)
    if n < 2:
        return np.zeros(values.shape[1])
    lo, hi = min(2 * n // 5, n - 2), max(min(2 * n // 5, n - 2) + 1, 3 * n // 5)
    gaps = values[lo + 1 : hi + 1] - values[lo:hi]
    at = lo + gaps.argmax(axis=0)
    columns = np.arange(values.shape[1])
    return (values[at, columns] + values[at + 1, columns]) / 2


def learned(sample: np.ndarray, iterations: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Projection and cuts: principal directions of the centred sample, then rotations fitted by iterative quantisation from several starts."""
    centred = sample - sample.mean(axis=0)
    bits = min(ROTATION, sample.shape[1])
    _, _, axes = np.linalg.svd(centred.T @ centred)
    flat = centred @ axes[:bits].T
    made = []
    for k in range(BITS // bits):
        r, _ = np.linalg.qr(np.random.default_rng(k).normal(size=(bits, bits)))
        for _ in range(iterations):
            signs = np.where(flat @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ flat)
            r = (u @ v).T
        made.append(axes[:bits].T @ r)
    projection = np.concatenate(made, axis=1)
    return projection, middle(sample @ projection)


def pairs_at(sample: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of cosine least: sampled vectors, and these turned towards other sampled vectors, or towards any direction."""
    rnd = np.random.default_rng(0)
    x = sample[rnd.integers(0, len(sample), MADE)]
    out = []
    for towards in (sample[rnd.integers(0, len(sample), MADE)], rnd.normal(size=x.shape)):
        away = towards - (towards * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        out.append((x[some], least * x[some] + np.sqrt(1 - least * least) * away[some] / size[some]))
    return [p for p in out if len(p[0])]


def substrings(n_bits: int, width: int, tables: int) -> np.ndarray:
    """The bits of each table's key: shuffled bits, cut into substrings, as often as it takes."""
    rnd, out = np.random.default_rng(1), []
    while len(out) < tables:
        order = rnd.permutation(n_bits)
        out += [order[i : i + width] for i in range(0, n_bits - width + 1, width)]
    return np.array(out[:tables], np.int64).reshape(tables, width)


def recall_of(differ: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Share of pairs that have met, after each table. differ: for each pair, the bits in which its codes differ."""
    met, out = np.zeros(len(differ), bool), []
    for bits in tables:
        met |= ~differ[:, bits].any(axis=1)
        out.append(met.mean())
    return np.array(out)


def planned(sample: np.ndarray, nodes: int, least: float, recall: float, width: int | None) -> Coder:
    """A coder for so many vectors of one length, of which sample holds some (normal)."""
    spread = thinned(sample, least)
    projection, cuts = learned(spread)
    kinds = [(a @ projection > cuts) != (b @ projection > cuts) for a, b in pairs_at(spread, least) + pairs_at(sample, least)]
    n_bits = projection.shape[1]
    apart = max((int(d.sum(axis=1).max()) for d in kinds), default=n_bits)  # of some thousand pairs: fewer than 1 in 1000 are further apart
    best = None
    for w in range(1, min(32, n_bits) + 1) if width is None else [width]:
        if width is None and w > 4 and (1 << w) > 8 * nodes:
            break
        tables = substrings(n_bits, w, min(MOST_TABLES, 64 if best is None else 2 * len(best[1]) + 64))
        met = np.min([recall_of(d, tables) for d in kinds], axis=0) if kinds else np.ones(len(tables))
        if met[-1] < recall:
            if width is not None:
                best = (0, tables)
            continue
        tables = tables[: int(np.argmax(met >= recall)) + 1]
        cost = len(tables) * (ROW_COST + nodes / (1 << w))
        if best is None or cost < best[0]:
            best = (cost, tables)
    tables = best[1] if best else np.zeros((1, 0), np.int64)  # no table brings enough together: one bucket
    return Coder(projection, cuts, tables, apart)


PLACED_DDL = "bucket long, tab int, size int, id long, code binary"


def first_met(coder: Coder, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Which pairs of codes that meet in a table meet in none before. a, b: rows of words."""
    differ, left = a ^ b, np.arange(len(a))
    for mask in coder.masks()[:table]:
        left = left[(differ[left] & mask).any(axis=1)]
    return left


def streamed(batches: Iterator[pa.RecordBatch], read, deal):
    """Groups of a sorted stream: read(batch) gives columns with bucket, block and is_left; deal(left, right) takes a group's own members with each part of all that pass by, themselves first (right is left)."""
    current, waiting, left = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = read(batch)
        group = np.stack([x["bucket"], x["block"].astype(np.int64)], axis=1)
        at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1) | (x["is_left"][1:] != x["is_left"][:-1])))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(group)], strict=True):
            key, mine = tuple(group[lo].tolist()), {c: v[lo:hi] for c, v in x.items()}
            if key != current:
                if waiting:
                    left = {c: np.concatenate([w[c] for w in waiting]) for c in mine}
                    yield from deal(left, left)
                current, waiting, left = key, [], None
            if x["is_left"][lo]:
                waiting.append(mine)
                continue
            if waiting:
                left, waiting = {c: np.concatenate([w[c] for w in waiting]) for c in mine}, []
                yield from deal(left, left)
            if left is not None:
                yield from deal(left, mine)
    if waiting:
        left = {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}
        yield from deal(left, left)


def words_of(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def probing(shared):
    """mapInArrow function over sorted members: those whose code is near another's that they meet here first."""

    def read(batch: pa.RecordBatch) -> dict:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "block", "id", "size", "tab")}
        return x | {"is_left": np.asarray(batch.column("is_left")), "code": words_of(batch.column("code"), WORDS, "<u8")}

    def deal(left: dict, right: dict) -> Iterator[pa.RecordBatch]:
        if left is right and len(left["id"]) < 2:
            return
        coder, table = shared.value[int(left["size"][0])], int(left["tab"][0])
        near = [np.zeros(len(left["id"]), bool), np.zeros(len(right["id"]), bool)]
        step = max(1, (1 << 20) // max(1, len(right["id"])))
        for i in range(0, len(left["id"]), step):
            apart = np.zeros((min(step, len(left["id"]) - i), len(right["id"])), np.uint16)
            for w in range(WORDS):
                apart += np.bitwise_count(left["code"][i : i + step, None, w] ^ right["code"][None, :, w])
            a, b = np.nonzero((apart <= coder.apart) & (left["id"][i : i + step, None] < right["id"][None, :]))
            a += i
            for k in range(0, len(a), 1 << 16):
                p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                wanted = ~(near[0][p] & near[1][q])  # where both are known to go on there is nothing to find out
                p, q = p[wanted], q[wanted]
                new = first_met(coder, left["code"][p], right["code"][q], table)
                near[0][p[new]] = True
                near[1][q[new]] = True
                if left is right:
                    near[0] |= near[1]
                    near[1] = near[0]
        for x, some in ((left, near[0]), (right, near[1]))[: 1 if left is right else 2]:
            if some.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(x[c][some]) for c in ("bucket", "tab", "size", "id")), pa.array([c.tobytes() for c in x["code"][some]], pa.binary())], ["bucket", "tab", "size", "id", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from streamed(batches, read, deal)

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the links a, b of n nodes connect."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def comparing(shared, least: float, kind: str):
    """mapInArrow function over sorted members with their vectors: counts of links by node, and edges of a forest of the links."""

    def read(batch: pa.RecordBatch) -> dict:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "block", "id", "n", "size", "tab")}
        # vectors of a batch can differ in length: kept as bytes until a bucket, which has one length, is at hand
        vec = np.empty(batch.num_rows, object)
        vec[:] = batch.column("vec").to_pylist()
        return x | {"is_left": np.asarray(batch.column("is_left")), "code": words_of(batch.column("code"), WORDS, "<u8"), "vec": vec}

    def deal(left: dict, right: dict) -> Iterator[pa.RecordBatch]:
        size, table = int(left["size"][0]), int(left["tab"][0])
        coder = shared.value[size]
        x, y = (normal(np.frombuffer(b"".join(s["vec"].tolist()), kind).reshape(-1, size)) for s in (left, right))
        for i in range(0, len(x), 1024):
            a, b = np.nonzero((x[i : i + 1024] @ y.T >= least) & (left["id"][i : i + 1024, None] < right["id"][None, :]))
            a += i
            new = np.concatenate([k + first_met(coder, left["code"][a[k : k + (1 << 16)]], right["code"][b[k : k + (1 << 16)]], table) for k in range(0, len(a), 1 << 16)] or [np.zeros(0, np.int64)])
            a, b = a[new], b[new]
            if len(a):
                ids, at = np.unique(np.concatenate([left["id"][a], right["id"][b]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([right["n"][b], left["n"][a]]), len(ids)).astype(np.int64)
                nodes, roots = forest(at[: len(a)], at[len(a) :], len(ids))
                other = np.full(len(ids), -1)
                other[nodes] = roots
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(ids[np.maximum(other, 0)], mask=other < 0)], ["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from streamed(batches, read, deal)

    return run


def coding(shared, kind: str):
    """mapInArrow function: id, size (components), vec to bucket, tab (number of the table), size, id, code: a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                mine, coder = batch.filter(pa.array(sizes == size)), shared.value[size]
                bits = coder.bits(normal(words_of(mine.column("vec"), size, kind)))
                code = pa.array([c.tobytes() for c in packed(bits)], pa.binary())
                n = mine.num_rows
                for t in range(len(coder.tables)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(coder.keys(bits, t).view(np.int64)), pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, size, np.int32)), mine.column("id"), code], ["bucket", "tab", "size", "id", "code"]
                    )

    return run


def dealt(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """members of buckets, sorted by bucket and block, a block's own first; members of large buckets also pass by the other blocks."""
    placed = members.join(blocks, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("is_left", F.col("own") == F.col("block")).drop("own", "blocks")
    return placed.repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.col("is_left").desc())


def links(nodes: DataFrame, kind: str, least: float, recall: float, sample: int, width: int | None) -> tuple[DataFrame, DataFrame]:
    """nodes: id, n, size, one, vec. Returns counts of links (id, n) and edges (id, other), some of them more than once."""
    spark = nodes.sparkSession
    counts = {r["size"]: r["count"] for r in nodes.groupBy("size").count().collect()}  # a row for each vector length
    if not counts:
        return spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "id long, other long")
    total, coders = sum(counts.values()), {}
    drawn = F.lit(False)
    for size, count in counts.items():
        share = min(1.0, max(sample * count / total, min(256, sample)) / count)
        drawn = drawn | ((F.col("size") == size) & (F.pmod(F.col("one"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    at_hand: dict[int, list] = {size: [] for size in counts}
    for r in nodes.where(drawn).select("size", "vec", "one").orderBy("one").toLocalIterator():  # about `sample` vectors, 256 of each length at least
        at_hand[r["size"]].append(np.frombuffer(r["vec"], kind))
    for size, count in counts.items():
        rows = at_hand[size] or [np.frombuffer(r["vec"], kind) for r in nodes.where(F.col("size") == size).select("vec").limit(1).collect()]
        coders[size] = planned(normal(np.array(rows)), count, least, recall, min(width, BITS) if width else None)
    shared = spark.sparkContext.broadcast(coders)  # for each vector length, a matrix of its components by 256

    def placed(some: DataFrame) -> DataFrame:
        return some.select("id", "size", "vec").mapInArrow(tidied(coding(shared, kind)), PLACED_DDL)

    # buckets with more than a block's members: found by one of every so many ids, as it decides only how the work is dealt
    every = 32 if total > 32 * BLOCK else 1
    counted = placed(nodes.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0)).groupBy("bucket").agg((F.count("*") * every).alias("count"))
    blocks, _ = written(counted.where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    near, _ = written(dealt(placed(nodes), blocks).mapInArrow(tidied(probing(shared)), PLACED_DDL))
    met = near.distinct().join(nodes.select("id", "n", "vec"), "id")
    found, _ = written(dealt(met, blocks).mapInArrow(tidied(comparing(shared, least, kind)), "id long, n long, other long"))
    return found.groupBy("id").agg(F.sum("n").alias("n")), found.where("other IS NOT NULL").select("id", "other")


def near_vectors(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", least: float = 0.9, recall: float = 0.98, sample: int = 20_000, width: int | None = None) -> DataFrame:
    """vectors with n_links, component_id (the smallest id reachable) and kept (id = component_id); columns of these names are replaced.

    sample: about how many vectors the rotations are learned from (those of the smallest hash; at least 256 of each
    vector length, or all). recall: of pairs just at the threshold; more similar ones meet more often. width: bits of
    a table's key; by default what costs least for that many vectors.
    """
    single = vectors.schema[vector].dataType.jsonValue().get("elementType") == "float"
    kind = "<f4" if single else "<f8"
    values = F.col(f"`{vector}`") if single else F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), F.col(vec_id).cast("long").alias("id"), values.alias("vector"))

    def of_id() -> DataFrame:
        prepared, _ = written(rows.select("id", "vector").mapInArrow(tidied(preparing(kind)), "id long, one long, two long, vec binary"))
        good = prepared.where("vec IS NOT NULL")
        size = (F.length("vec") / (4 if single else 8)).cast("int")
        nodes, _ = written(good.groupBy("one", "two").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("size", size))
        counts, edges = links(nodes.select("id", "n", "size", "one", "vec"), kind, least, recall, sample, width)
        label = components(edges.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct())
        members = good.select("id", "one", "two").join(nodes.select("one", "two", F.col("id").alias("node"), F.col("n").alias("same")), ["one", "two"])
        linked = members.join(counts.withColumnRenamed("id", "node"), "node", "left").join(label, "node", "left")
        return linked.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("same") - 1).alias("links"), F.min(F.coalesce("label", "node")).alias("component"))

    joined = rows.join(result(of_id), "id", "left")
    component = F.coalesce("component", "id")
    new = {"n_links": F.coalesce("links", F.lit(0)).cast("long"), "component_id": component, "kept": F.coalesce(F.col("id") == component, F.lit(True))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in vectors.columns], *[v.alias(k) for k, v in new.items() if k not in vectors.columns])
