"""Near-duplicate documents by BagMinHash over the multiset of five-word shingles.

A document is a bag: each shingle (five words in a row; all words of a shorter text) with its count as weight.
Weights are discretised as whole numbers and arranged in dyadic blocks (0,1], (1,2], (2,4], (4,8], ...; every shingle
has in each block a Poisson process of its own, whose points carry a time, a register and a weight. A register takes
the earliest time of all points not above the weights of their shingles, so two bags agree in a register with the
probability of their weighted Jaccard similarity. Points of a shingle are drawn one by one, in order of time, and only
while they come before the latest register, so most shingles draw a point or two.

Signatures are banded. In a bucket the members that a hash puts first are hubs (one of four hashes, by band), and every
member is a candidate with each hub; a block of documents sends only the first members of its buckets on and settles
the others, so the pairs don't grow with the square of a group. In buckets of up to `whole` members all pairs are
candidates. A pair whose signatures agree far too little is dropped; of the rest, first the best few of each document,
then all that still join different classes, the overlap of the bags themselves is computed.

The members of a larger bucket that hubs have not brought into its main class are then a query set: in blocks, each
query's bag is met with the bags of all members of the buckets that it is in. A block has an index from shingle to its
queries, so a member's overlaps with all of them come out of one pass over its shingles; those that are in one class
by then are left out. No pairs leave a block, only the links that join classes, so what is written grows with the
members, and nothing is dropped untested. The work is the query set times the bucket.

Texts with the same words are one node from the start. Nulls, empty texts and texts without words link with nothing.
A null doc_id comes after all numbers; repeated rows (same doc_id, same text) share a class, and one of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, LAST, Rolling, begins, blocks, mixed, n_buckets, ordered, overlaid, removed, result, stretch_hashes, text_bytes, tidied, words, written
from .components import components

#: Orders in which bands take their hubs; a band's key has the number of its order in its lowest bits.
ORDERS = 4
#: Pairs of each document that are verified before those that still join different classes.
FIRST = 4
GAMMA = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: shingle hashes, their counts, the text of each (in order); and two hashes of each text's words."""
    data, offsets = text_bytes(column)
    starts, ends, doc = words(data, offsets)
    rolls = [Rolling(stretch_hashes(data, starts, ends, b), b2) for b, b2 in zip(BASES, BASES[::-1], strict=True)]
    first = np.searchsorted(starts, offsets)
    n = max(0, len(doc) - size + 1)
    at = np.flatnonzero(doc[:n] == doc[size - 1 : size - 1 + n])
    lo, hi = first[:-1], first[1:]
    short = np.flatnonzero((hi - lo > 0) & (hi - lo < size))
    h = np.concatenate([rolls[0].windows(size)[at], rolls[0].of(lo[short], hi[short])])
    d = np.concatenate([doc[at], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(begins(d, h))
    whole = [r.of(lo, hi) for r in rolls]
    return h[new], np.diff(np.append(new, len(h))), d[new], whole[0], whole[1]


def unit(x: np.ndarray) -> np.ndarray:
    """Integers to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * (1.0 / (1 << 53))


def bag_min_hash(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures: for each document, registers of 64 bits. h, weight, doc: shingles, counts, and whose they are."""
    low, length = 0, 1
    entries, owners, weights, lows, lengths = [], [], [], [], []
    block = 0
    while True:
        has = weight > low
        if not has.any():
            break
        entries.append(mixed(h[has] ^ mixed(np.full(1, block + 1, np.uint64))))
        owners.append(doc[has])
        weights.append(weight[has])
        lows.append(np.full(int(has.sum()), low))
        lengths.append(np.full(int(has.sum()), length))
        low, length, block = low + length, low + length, block + 1
    times = np.full((docs, registers), np.inf)
    if not entries:
        return np.zeros((docs, registers), np.uint64)
    state, owner, top, low_, len_ = (np.concatenate(x) for x in (entries, owners, weights, lows, lengths))
    time, flat = np.zeros(len(state)), times.reshape(-1)
    latest = np.full(docs, np.inf)
    while len(state):
        state = state + GAMMA
        a = mixed(state)
        time = time - np.log(unit(a)) / (len_ * registers)
        go = time < latest[owner]
        state, owner, top, low_, len_, time, a = (x[go] for x in (state, owner, top, low_, len_, time, a))
        b = mixed(a ^ GAMMA)
        register = (b >> np.uint64(40)) % np.uint64(registers)
        level = low_ + 1 + ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) / 4294967296.0 * len_).astype(np.int64)
        right = level <= top
        np.minimum.at(flat, owner[right] * registers + register[right].astype(np.int64), time[right])
        latest = times.max(axis=1)
    return mixed(times.view(np.uint64))


def signing(size: int, registers: int, band: int):
    """mapInArrow function: ord, key, text to the table of signatures; texts without words give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            h, n, d, one, two = shingles(batch.column("text"), size)
            has = np.unique(d)
            if not len(has):
                continue
            seen = np.unique(np.stack([one[has], two[has]], axis=1), axis=0, return_index=True, return_inverse=True)
            firsts, which = has[seen[1]], seen[2].reshape(-1)  # a text's signature is made once in a block
            dense = np.full(batch.num_rows, -1)
            dense[firsts] = np.arange(len(firsts))
            mine = dense[d] >= 0
            signature = bag_min_hash(h[mine], n[mine], dense[d[mine]], len(firsts), registers)
            keys = np.zeros((len(firsts), registers // band), np.uint64)
            for j in range(band):
                keys = mixed(keys * GAMMA + signature[:, j::band][:, : registers // band])
            turns = np.arange(registers // band, dtype=np.uint64)
            keys = mixed(keys + turns) // np.uint64(ORDERS) * np.uint64(ORDERS) + turns % np.uint64(ORDERS)
            signs = (signature & np.uint64(0xFF)).astype(np.uint8)
            total = np.bincount(d, n, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ord").take(pa.array(has)), batch.column("key").take(pa.array(has)), pa.array(one[has].view(np.int64)), pa.array(two[has].view(np.int64)),
                    pa.array(total[has]), pa.array([keys[i].tobytes() for i in which.tolist()], pa.binary()), pa.array([signs[i].tobytes() for i in which.tolist()], pa.binary()),
                ],
                ["ord", "key", "one", "two", "total", "bands", "signs"],
            )

    return run


SIGNED_DDL = "ord long, key long, one long, two long, total long, bands binary, signs binary"
#: A member of a bucket.
MEMBER = np.dtype([("band", "<u8"), ("ord", "<i8"), ("key", "<i8")])
PAIR = np.dtype([("x", "<i8"), ("xk", "<i8"), ("y", "<i8"), ("yk", "<i8")])
EXCHANGED_DDL = "bucket int, members binary, pairs binary"
PAIRS_DDL = "a_ord long, a_key long, b_ord long, b_key long"


def hub_pairs(m: np.ndarray, hubs: int, whole: int, all_here: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's members with its hubs, and its first members: hubs and those that may have to be hubs.

    all_here: buckets are complete, so those of up to whole members give all pairs. Otherwise they are a block's, and
    only members after the first whole are settled here.
    """
    turn = mixed(m["band"] % np.uint64(ORDERS) ^ mixed(m["key"].view(np.uint64)))
    order = np.lexsort((m["key"], m["ord"], turn, m["band"]))
    m = m[order]
    m = m[begins(m["band"], m["ord"], m["key"])]
    new = begins(m["band"])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(m) else np.zeros(0, np.int64)
    place = np.arange(len(m)) - first
    size = np.diff(np.append(np.flatnonzero(new), len(m)))[np.cumsum(new) - 1] if len(m) else place
    out = []
    for k in range(whole if all_here else hubs):
        has = np.flatnonzero((place > k) & ((k < hubs) | (size <= whole)) if all_here else place >= whole)
        p = np.zeros(len(has), PAIR)
        hub = m[first[has] + k]
        p["x"], p["xk"], p["y"], p["yk"] = m["ord"][has], m["key"][has], hub["ord"], hub["key"]
        out.append(p)
    pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, PAIR)
    flip = (pairs["x"] > pairs["y"]) | ((pairs["x"] == pairs["y"]) & (pairs["xk"] > pairs["yk"]))
    pairs["x"][flip], pairs["y"][flip] = pairs["y"][flip].copy(), pairs["x"][flip].copy()
    pairs["xk"][flip], pairs["yk"][flip] = pairs["yk"][flip].copy(), pairs["xk"][flip].copy()
    return np.unique(pairs), m[place < whole]


def sending(hubs: int, whole: int, buckets: int):
    """mapInArrow function: nodes with bands to a row per bucket with hubs to compare and pairs already known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<u8")
            m = np.zeros(len(keys), MEMBER)
            m["band"], m["ord"], m["key"] = keys, np.repeat(batch.column("ord").to_numpy(), len(keys) // n), np.repeat(batch.column("key").to_numpy(), len(keys) // n)
            pairs, m = hub_pairs(m, hubs, whole, all_here=False)
            to, pair_to = ((x >> np.uint64(8)) % np.uint64(buckets) for x in (m["band"], mixed(pairs["xk"].view(np.uint64)) ^ pairs["yk"].view(np.uint64)))
            order, pair_order = np.lexsort((m["ord"], to)), np.argsort(pair_to, kind="stable")
            m, to, pairs, pair_to = m[order], to[order], pairs[pair_order], pair_to[pair_order]
            each = np.arange(buckets, dtype=np.uint64)
            lo, hi, plo, phi = (np.searchsorted(x, each, side=s) for x, s in ((to, "left"), (to, "right"), (pair_to, "left"), (pair_to, "right")))
            some = np.flatnonzero((hi > lo) | (phi > plo)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([m[lo[b] : hi[b]].tobytes() for b in some], pa.binary()), pa.array([pairs[plo[b] : phi[b]].tobytes() for b in some], pa.binary())],
                ["bucket", "members", "pairs"],
            )

    return run


def pairing(hubs: int, whole: int):
    """mapInArrow function over whole buckets: the candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, pairs = [], []
        for batch in batches:
            members.append(np.frombuffer(b"".join(batch.column("members").to_pylist()), MEMBER))
            pairs.append(np.frombuffer(b"".join(batch.column("pairs").to_pylist()), PAIR))
        if not members:
            return
        found, _ = hub_pairs(np.concatenate(members), hubs, whole, all_here=True)
        p = np.unique(np.concatenate([found, *pairs]))
        for i in range(0, len(p), 100_000):
            part = p[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c])) for c in ("x", "xk", "y", "yk")], ["a_ord", "a_key", "b_ord", "b_key"])

    return run


def agreeing(least: float):
    """mapInArrow function: pairs with signatures a_signs, b_signs to those that agree in a share of registers that is not below least, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a_signs", "b_signs"))
                share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                ok = pa.array(share >= least)
                kept = batch.select(["a", "b"]).filter(ok)
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), pa.array(share[share >= least])], ["a", "b", "share"])

    return run


def bagging(size: int):
    """mapInArrow function: node, text to node, bag (shingle hashes of 64 bits, ascending, and their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            h, n, d, _, _ = shingles(batch.column("text"), size)
            at = np.searchsorted(d, np.arange(batch.num_rows + 1))
            bags = [np.concatenate([h[a:b].view("<u8"), n[a:b].astype("<u8")]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bags, pa.binary())], ["node", "bag"])

    return run


def overlap(one: bytes, two: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    a, b = (np.frombuffer(x, "<u8").reshape(2, -1) for x in (one, two))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def verifying(least: float):
    """mapInArrow function: a, b, a_bag, b_bag to the pairs whose overlap is not below least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [overlap(x, y) for x, y in zip(batch.column("a_bag").to_pylist(), batch.column("b_bag").to_pylist(), strict=True)]
            kept = batch.append_column("similarity", pa.array(same, pa.float64())).filter(pa.array([s >= least for s in same], pa.bool_()))
            yield kept.select(["a", "b", "similarity"])

    return run


#: Bytes of bags of the queries that one task holds, and members that it meets them with.
QUERY_BYTES, BLOCK = 8 << 20, 2048


def unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: ord, key, bands to band, ord, key."""
    for batch in batches:
        if batch.num_rows:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            each = len(bands) // batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(bands), *(pa.array(np.repeat(batch.column(c).to_numpy(), each)) for c in ("ord", "key"))], ["band", "ord", "key"])


class Index:
    """Bags of a block of queries by shingle, and which classes of them are joined by now."""

    def __init__(self, bags: list[bytes]):
        parts = [np.frombuffer(x, "<u8").reshape(2, -1) for x in bags]
        owner = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        self.total = np.bincount(owner, n, len(parts)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.owner, self.n, h = owner[order].astype(np.int32), n[order].astype(np.int64), h[order]
        self.at = np.append(np.flatnonzero(begins(h)), len(h))
        self.h = h[self.at[:-1]]

    def overlaps(self, bag: bytes) -> np.ndarray:
        """Weighted Jaccard similarity of a bag with each query's."""
        h, n = np.frombuffer(bag, "<u8").reshape(2, -1)
        place = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        some = self.h[place] == h
        place, n = place[some], n[some].astype(np.int64)
        lengths = self.at[place + 1] - self.at[place]
        ends = np.cumsum(lengths)
        at = np.repeat(self.at[place] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        shared = np.bincount(self.owner[at], np.minimum(self.n[at], np.repeat(n, lengths)), len(self.total))
        return shared / (self.total + int(np.frombuffer(bag, "<u8").reshape(2, -1)[1].sum()) - shared)


class Joined:
    """Classes, and which of them are one (union by root, paths halved)."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, x, y) -> None:
        self.above[self.root(x)] = self.root(y)


LINKED_DDL = "a_ord long, a_key long, b_ord long, b_key long"


def linking(least: float):
    """mapInArrow function over blocks (home, i, j), queries first: links that join classes, between queries and members that pass by."""

    def met(queries: list[dict], members: Iterator[dict]) -> Iterator[tuple]:
        index, joined = Index([q["bag"] for q in queries]), Joined()
        classes = [(q["cls_ord"], q["cls_key"]) for q in queries]
        place = {(q["ord"], q["key"]): k for k, q in enumerate(queries)}
        roots, stale = classes, True
        for m in members:
            mine = joined.root((m["cls_ord"], m["cls_key"]))
            if stale:
                roots, stale = [joined.root(c) for c in classes], False
            before = place.get((m["ord"], m["key"]), len(queries))  # two queries of the block meet once
            if all(r == mine for r in roots[:before]):
                continue
            near = np.flatnonzero(index.overlaps(m["bag"])[:before] >= least)
            for k in near.tolist():
                if joined.root(classes[k]) != joined.root(mine):
                    joined.join(classes[k], mine)
                    stale = True
                    yield m["ord"], m["key"], queries[k]["ord"], queries[k]["key"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for small in blocks([batch], "bag"):
                yield from small.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), key=lambda r: (r["home"], r["i"], r["j"])):
            queries: list[dict] = []
            first = next((r for r in group if not r["asks"] or queries.append(r)), None)
            if first is not None and queries:
                found = list(met(queries, chain([first], group)))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["a_ord", "a_key", "b_ord", "b_key"])

    return run


NODE = "struct<ord:bigint,key:bigint>"


def node(ord_: str, key: str):
    return F.struct(F.col(ord_).alias("ord"), F.col(key).alias("key"))


def links(keyed: DataFrame, size: int, least: float, registers: int, band: int, hubs: int, whole: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """keyed: ord, key, text. Returns members (ord, key, node: the first row with the same words) and the classes of nodes that links name (node, label)."""
    signed, _ = written(keyed.mapInArrow(tidied(signing(size, registers, band)), SIGNED_DDL))
    least_of = signed.groupBy("one", "two").agg(F.min(node("ord", "key")).alias("node"), F.first("bands").alias("bands"), F.first("signs").alias("signs"))
    nodes, _ = written(least_of)
    members = signed.select("ord", "key", "one", "two").join(nodes.select("one", "two", "node"), ["one", "two"]).select("ord", "key", "node")
    buckets = n_buckets(nodes)
    sent = nodes.select("node.ord", "node.key", "bands").mapInArrow(tidied(sending(hubs, whole, buckets)), EXCHANGED_DDL)
    paired = sent.repartition(buckets, "bucket").mapInArrow(tidied(pairing(hubs, whole)), PAIRS_DDL).distinct()
    pairs = paired.select(node("a_ord", "a_key").alias("a"), node("b_ord", "b_key").alias("b"))
    signs = nodes.select("node", "signs")
    with_signs = pairs.join(signs.select(F.col("node").alias("a"), F.col("signs").alias("a_signs")), "a").join(signs.select(F.col("node").alias("b"), F.col("signs").alias("b_signs")), "b")
    open_, open_at = written(with_signs.select("a", "b", "a_signs", "b_signs").mapInArrow(tidied(agreeing(least - slack)), f"a {NODE}, b {NODE}, share double"))
    flat = nodes.select("node.ord", "node.key", "bands").mapInArrow(tidied(unpacking), "band long, ord long, key long")
    large, _ = written(flat.groupBy("band").count().where(F.col("count") > whole).select("band"))  # written, so that its size is known where it is joined
    crowded, _ = written(flat.join(large, "band", "left_semi").select("band", node("ord", "key").alias("node")))
    named = open_.select(F.col("a").alias("node")).union(open_.select(F.col("b").alias("node"))).union(crowded.select("node")).distinct()
    texts = keyed.select(node("ord", "key").alias("node"), "text").join(named.hint("merge"), "node", "left_semi").dropDuplicates(["node"])  # named grows with the documents
    bags, _ = written(texts.mapInArrow(tidied(bagging(size)), f"node {NODE}, bag binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        bagged = pairs.select("a", "b").join(bags.select(F.col("node").alias("a"), F.col("bag").alias("a_bag")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("b_bag")), "b")
        return written(bagged.select("a", "b", "a_bag", "b_bag").mapInArrow(tidied(verifying(least)), f"a {NODE}, b {NODE}, similarity double"))[0]

    best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("share").desc(), "b"))
    ranked, at = written(open_.withColumn("turn", best))
    removed(open_at)
    found = verified(ranked.where(F.col("turn") <= FIRST))
    label = components(found)
    rest = ranked.where(F.col("turn") > FIRST).select("a", "b").join(label.select(F.col("node").alias("a"), F.col("label").alias("of_a")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("of_b")), "b", "left")
    found = found.union(verified(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))))
    removed(at)
    label = components(found)

    placed = crowded.join(label.select("node", F.col("label").alias("cls")), "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    sizes = placed.groupBy("band", "cls").count()
    main = sizes.groupBy("band").agg(F.max(F.struct("count", "cls")).alias("m"), F.count("*").alias("classes"), F.sum("count").alias("count")).where("classes > 1").select("band", "count", F.col("m.cls").alias("main"))
    several, _ = written(placed.join(main, "band").select("band", "node", "cls", "count", (F.col("cls") != F.col("main")).alias("asks")))
    # a query belongs to a block of one bucket, and meets the members of all of its buckets there; of its buckets, and those
    # of the queries that share one with it, the largest, so that members of many buckets go to few blocks
    queried = several.where("asks").select("node", "cls", "band", "count")
    largest = F.max(F.struct("count", "band"))
    own, _ = written(queried.join(queried.groupBy("node").agg(largest.alias("own")), "node"))
    of_band = own.groupBy("band").agg(F.max("own").alias("near"))
    homes, _ = written(own.join(of_band, "band").groupBy("node", "cls").agg(F.max("near")["band"].alias("home")).join(bags, "node"))
    parts = homes.groupBy("home").agg(F.ceil(F.sum(F.length("bag")) / QUERY_BYTES).cast("int").alias("parts"))
    queries, _ = written(homes.select("node", "cls", "home").join(parts, "home").select("node", "cls", "home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i")))
    asked = several.where("asks").select("band", "node").join(queries.select("node", "home", "i"), "node").select("band", "home", "i").distinct()
    passing, _ = written(several.select("band", "node", "cls").join(asked, "band").select("home", "i", "node", "cls").distinct())
    dealt = passing.groupBy("home", "i").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("times"))
    columns = ["home", "i", "j", "asks", "node.ord", "node.key", F.col("cls.ord").alias("cls_ord"), F.col("cls.key").alias("cls_key"), "bag"]
    asking = queries.join(dealt, ["home", "i"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("asks", F.lit(True))
    others = passing.join(dealt, ["home", "i"]).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("times")).cast("int")).withColumn("asks", F.lit(False))
    together = asking.join(bags, "node").select(columns).union(others.join(bags, "node").select(columns))
    together = together.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", F.col("asks").desc(), "ord", "key")
    more, _ = written(together.mapInArrow(tidied(linking(least)), LINKED_DDL))
    return members, components(found.select("a", "b").union(more.select(node("a_ord", "a_key"), node("b_ord", "b_key"))))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, least: float = 0.8, registers: int = 128, band: int = 4, hubs: int = 3, whole: int = 9, slack: float = 0.2) -> DataFrame:
    """docs with class_id (smallest doc_id of the class; null if that is null) and kept (one row of each class: its first).

    A class is connected by pairs of weighted Jaccard similarity least or more. band: registers per band (a pair at
    0.8 is missed by 32 bands of 4 with probability 5e-8). hubs: of a bucket of more than whole members. slack: how far below least the share of equal registers may
    be before a pair is dropped untested (0.2 is over five standard deviations of 128 registers).
    """
    if registers % band:
        raise ValueError("band divides registers")
    rows = ordered(docs, text, doc_id)

    def classes() -> DataFrame:
        members, label = links(rows.select("ord", "key", "text"), size, least, registers, band, hubs, whole, slack)
        of_row = members.groupBy("ord", "key").agg(F.first("node").alias("node"), F.count("*").alias("rows"))
        return of_row.join(label, "node", "left").select("ord", "key", F.coalesce("label", "node").alias("class"), "rows")

    of_row = result(classes)
    joined = rows.drop("text").join(of_row, ["ord", "key"], "left")
    alone = F.col("class").isNull()
    leads = (F.col("class.ord") == F.col("ord")) & (F.col("class.key") == F.col("key"))
    kept = alone | leads
    if not of_row.where(leads & (F.col("rows") > 1)).isEmpty():  # of equal rows one is kept: the first of a part of them, then of the parts
        one = F.monotonically_increasing_id()
        turn = F.when(leads & (F.col("rows") > 1), F.pmod(one, F.lit(1024))).otherwise(one + 1024)
        joined = joined.withColumn("turn", turn).repartition("ord", "key", "turn")
        joined = joined.withColumn("turn", F.when((F.col("turn") < 1024) & (F.row_number().over(Window.partitionBy("ord", "key", "turn").orderBy("turn")) == 1), F.lit(0)).otherwise(1 + F.monotonically_increasing_id()))
        joined = joined.repartition("ord", "key", "turn").withColumn("first", (F.col("turn") == 0) & (F.row_number().over(Window.partitionBy("ord", "key", "turn").orderBy("turn")) == 1))
        kept = alone | leads & ((F.col("rows") == 1) | F.col("first"))
    class_ord = F.when(alone, F.col("ord")).otherwise(F.col("class.ord"))
    out = joined.select("row", F.when(class_ord != LAST, class_ord).alias("class_id"), kept.alias("kept"))
    return overlaid(out, "row", docs.columns, {"class_id": F.col("class_id"), "kept": F.col("kept")})
