import hashlib
import random
import re

import pytest

from hirameki.llm.exchange import narrow, widened
from hirameki.llm.substrings import levels, remove_repeats


def brute(rows, window):
    """(doc_id, text) rows to {row number: (n_words, n_removed, sha)} by the definition."""
    docs = [(i, d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (d, t) in enumerate(rows)]
    first = {}
    for i, d, w in docs:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), []).append((d, i, p))
    out = {}
    for i, d, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            for d2, i2, p2 in first[tuple(w[p : p + window])]:
                if (d2 is not None and (d is None or d2 < d)) or (i2 == i and p2 < p):
                    gone |= set(range(p, p + window))
                    break
        left = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def check(spark, rows, window, start):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, ord int")
    got = {r["ord"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(df.repartition(3), window=window, start=start).collect()}
    assert got == brute(rows, window)


@pytest.mark.parametrize("window,start", [(8, 2), (8, 4), (8, 8), (20, 10), (6, 4)])
def test_against_brute_force(spark, window, start):
    rnd = random.Random(window * 10 + start)
    passages = [[rnd.choice("abcdefg") + rnd.choice("xyé") for _ in range(rnd.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice("abcd") for _ in range(rnd.randint(1, 30))]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    rows += [(60, rows[3][1]), (61, None), (62, ""), (None, rows[3][1]), (3, rows[3][1]), (63, "w " * 300), (64, " ".join(passages[0] * 5))]
    check(spark, rows, window, start)


def test_text_is_kept_where_nothing_goes_and_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, "a  b\n c", "x"), (2, None, "y")], "doc_id long, text string, n_words string")
    rows = {r["doc_id"]: r for r in remove_repeats(df, window=4, start=2).collect()}
    assert rows[1]["text"] == "a  b\n c" and rows[1]["n_words"] == 3 and rows[2]["text"] is None


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels():
    assert levels(20, 10) == [10, 20] and levels(40, 10) == [10, 20, 40] and levels(8, 8) == [8]
    with pytest.raises(ValueError):
        levels(4, 5)


def test_document_ids_of_any_size(spark):
    text = " ".join(f"w{i}" for i in range(12))
    for ids in ([1, 2], [-(1 << 62), 1 << 62], [(1 << 40) + 1, (1 << 40) + 2], [5, (1 << 63) - 2], [None, None, 7]):
        check(spark, [(i, text) for i in ids], 6, 3)


@pytest.mark.parametrize("ids", [[1, 2], [-(1 << 62), 1 << 62], [(1 << 63) - 1], [5, (1 << 63) - 1], [0, (1 << 32) - 1], [0, 1 << 32]])
def test_narrow_and_widened(ids):
    import numpy as np

    raw = b"abc" + narrow(np.array(ids)) + b"de"
    values, end = widened(raw, len(ids), 3)
    assert values.tolist() == ids and raw[end:] == b"de"
