import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hirameki.llm import near
from hirameki.llm.components import components


def bag(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if 0 < len(w) < size:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute(rows, least):
    """Class of each row number: the smallest (doc_id, row) reachable."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= least:
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return [best.get(root(i)) for i in range(len(rows))]


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.random()}"
    return words


def corpus():
    rnd = random.Random(4)
    rows = []
    for g in range(25):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 400)) for _ in range(rnd.randint(40, 200))]
        for _ in range(rnd.randint(1, 8)):
            rows.append(" ".join(edited(base, rnd, rnd.choice([0, 1, 1, 2, 3, 10]))))
    rows += ["la la la " * 30, "la la la " * 29, "la la la " * 60, "one two", "one  two\n", "one three", "", " \n", rows[0]]
    rnd.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_against_brute_force(spark):
    rows = [*corpus(), (1000, None), (1001, None)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(4)
    got = near.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = dict(zip([d for d, _ in rows], brute(rows, 0.8), strict=True))
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "same text here and there"), (5, "same text here and there"), (5, "other words in another text"), (None, "same text here and there"), (None, "alone it stands in the table")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, 5, False), (5, 5, False), (5, 5, True), (5, 5, True)]
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_equal_rows_without_an_id(spark):
    text = "these are the words of a text that many rows without any id share"
    df = spark.createDataFrame([(None, text)] * 300 + [(4, "a text of its own that stands apart from all")] * 3, "doc_id long, text string").repartition(5)
    got = near.near_duplicates(df).collect()
    assert [sum(r["kept"] for r in got if r["doc_id"] == d) for d in (None, 4)] == [1, 1] and len(got) == 303


def test_index_gives_all_overlaps():
    rnd = random.Random(3)
    bags = []
    for _ in range(30):
        x = Counter({rnd.randrange(40): rnd.randrange(1, 4) for _ in range(20)})
        bags.append(x)
    raw = [np.concatenate([np.array(sorted(x), "<u8"), np.array([x[k] for k in sorted(x)], "<u8")]).tobytes() for x in bags]
    got = near.Index(raw[:20]).overlaps(raw[25])
    assert np.allclose(got, [similarity(x, bags[25]) for x in bags[:20]]) and got.tolist() == [near.overlap(x, raw[25]) for x in raw[:20]]


def test_signatures_are_unbiased():
    rnd = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        h = near.mixed(rnd.integers(0, 1 << 63, 120).astype(np.uint64))
        a, b = rnd.integers(0, 9, 120), rnd.integers(0, 9, 120)
        doc = np.repeat([0, 1], 120)
        w = np.concatenate([a, b])
        has = w > 0
        s = near.bag_min_hash(np.concatenate([h, h])[has], w[has], doc[has], 2, 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 3 * 0.5 / (30 * 512) ** 0.5 and np.std(errors) < 0.04


def test_a_large_group_makes_few_pairs():
    m = np.zeros(5000, near.MEMBER)
    m["band"], m["ord"], m["key"] = 7, np.arange(5000), np.random.default_rng(1).integers(0, 1 << 62, 5000)
    pairs, _ = near.hub_pairs(m, 3, 9, all_here=True)
    assert len(pairs) == 3 * 5000 - 6
    settled, first = near.hub_pairs(m, 3, 9, all_here=False)
    assert len(first) == 9 and len(settled) == 3 * (5000 - 9)
    assert len(near.hub_pairs(m[:9], 3, 9, all_here=True)[0]) == 36 and len(near.hub_pairs(m[:9], 3, 9, all_here=False)[0]) == 0


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_chains(spark, n):
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100 + i, 100) for i in range(1, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(links).collect()} == {i: 0 for i in range(n + 1)} | {100 + i: 100 for i in range(5)}


def family(n, planted, rnd, length=800, edits=10, same=2):
    """Texts with ten edits of one base: no two of them are links, but those that share two of their edits. The first are planted pairs."""
    base, slots = [f"w{i}" for i in range(length)], range(5, length - 5, 5)
    taken, out = [], []
    while len(out) < n:
        of = taken[-1] if len(out) < 2 * planted and len(out) % 2 else {}
        kept = dict(rnd.sample(sorted(of.items()), same)) if of else {}
        mine = kept | {i: f"e{rnd.random()}" for i in rnd.sample([i for i in slots if i not in of], edits - len(kept))}
        if all(len(mine.keys() & x.keys()) <= same for x in taken):
            taken.append(mine)
            out.append(" ".join(mine.get(i, w) for i, w in enumerate(base)))
    return out


@pytest.mark.parametrize("query_bytes, block", [(8 << 20, 2048), (100_000, 20)])
def test_links_in_a_family_just_below_the_threshold(spark, monkeypatch, query_bytes, block):
    monkeypatch.setattr(near, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(near, "BLOCK", block)
    texts = family(150, 40, random.Random(7))
    bags = [set(bag(t)) for t in texts]
    like = {(i, j): len(bags[i] & bags[j]) / len(bags[i] | bags[j]) for i in range(150) for j in range(i)}
    linked = {k for k, s in like.items() if s >= 0.8}
    assert len(linked) == 40 and min(like.values()) > 0.75
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(df).collect()}
    assert got == {i: i - 1 if i < 80 and i % 2 else i for i in range(150)}


def test_links_whose_signatures_agree_little(spark):
    texts = family(60, 25, random.Random(1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    h, n, d, _, _ = near.shingles(pa.array(texts), 5)
    signs = near.bag_min_hash(h, n, d, 60, 32).astype(np.uint8)
    shares = [((signs[i] == signs[i + 1]).mean() - 1 / 256) / (1 - 1 / 256) for i in range(0, 50, 2)]
    assert sum(s < 0.7 for s in shares) == 3 and min(shares) > 0.6
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(df, registers=32, hubs=1, whole=2).collect()}
    assert got == {i: i - 1 if i < 50 and i % 2 else i for i in range(60)}
