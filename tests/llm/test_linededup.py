import random

import pytest

from hirameki.llm import linededup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_chars, edits=1):
    """Removed line numbers of each row, doc_ids distinct and not null."""
    lines = [(d, i, x.strip(" \t\x0b\x0c\r")) for d, t in sorted(rows) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    out = {d: [] for d, _ in rows}
    for n, (d, i, x) in enumerate(lines):
        for _, _, y in lines[:n]:
            if x == y or (min(len(x), len(y)) >= min_chars and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits):
                out[d].append(i)
                break
    return out


def corpus(rnd, n, min_chars):
    alphabet = "abcé日😀 "
    base = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 40))) for _ in range(25)] + ["a" * min_chars, "ab" * min_chars, "a" * (min_chars - 1)]

    def line():
        x = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            at = rnd.randrange(len(x) + 1)
            x[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(alphabet)]])
        return rnd.choice(["", " ", "\t"]) + "".join(x) + rnd.choice(["", "\r", " "])

    return [(i, "\n".join(rnd.choice([line(), line(), "", " "]) for _ in range(rnd.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = [*corpus(random.Random(seed), 60, 8), (900, None), (901, ""), (902, "x" * 3000), (903, "x" * 2999 + "y")]
    want = brute(rows, 8)
    assert sum(map(len, want.values())) > 60
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, removed string").repartition(4)
    got = L.find_duplicate_lines(df, min_chars=8).collect()
    assert {r["doc_id"]: r["removed"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_removed"] == len(r["removed"]) and r["n_lines"] == sum(bool(x.strip()) for x in (r["text"] or "").split("\n")) for r in got)
    texts = {r["doc_id"]: r["text"] for r in L.drop_duplicate_lines(df, min_chars=8).collect()}
    assert texts == {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]) for d, t in rows}


@pytest.mark.parametrize("edits", [0, 2, 3])
def test_other_bounds(spark, edits):
    rows = [*corpus(random.Random(5), 40, 8), (900, None), (901, "")]
    want = brute(rows, 8, edits)
    assert want != brute(rows, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["removed"] for r in L.find_duplicate_lines(df, min_chars=8, edits=edits).collect()} == want


def test_within():
    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choices("ab", k=rnd.randint(0, 7))) for _ in range(2))
        assert all(L.within(a, b, e) == (distance(a, b) <= e) for e in (0, 1, 2, 3))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(4, "same line\nother"), (4, "same line\nother"), (None, "other\nown"), (2, "same line")]
    got = L.find_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["removed"]) for r in got) == [(-1, [0]), (2, []), (4, [0]), (4, [0])]
    assert L.find_duplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_edit():
    rnd = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(rnd.choices("ab", k=rnd.randint(0, 5))) for _ in range(2))
        assert L.one_edit(a, b) == (distance(a, b) <= 1)
