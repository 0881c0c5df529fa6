import random
import re

import duckdb
import pytest

from hirameki.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            again |= {i + j for i in places for j in range(5)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def texts():
    rnd = random.Random(3)
    out = [None, "", " \n\t", "a", "a\n\na\n a\na", "x " * 30, "é😀 # $%\x0b\x0c|<>&*", "a b c d e " * 2 + "f", "!! " * 20, "the of and to in a is that for on", "one two three four five six seven eight nine ten eleven"]
    return out + [rnd.choice(" \n\t").join(rnd.choices(["the", "ab", "c", "Ü", "#", "!", "x\n"], k=rnd.randint(0, 40))) for _ in range(150)]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*texts(), *texts()[:3]])], "doc_id long, text string, kept string")
    rows = quality.judge(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_sql_gives_the_same(spark):
    import pandas as pd

    docs = pd.DataFrame({"doc_id": range(len(texts())), "text": texts()})
    want = duckdb.sql(quality.oracle("docs")).df().sort_values("doc_id")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = quality.judge(df).select(*want.columns).toPandas().sort_values("doc_id")
    assert want.values.tolist() == got.values.tolist()


def test_threshold_table(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "doc_id long, text string")
    assert quality.judge(df).first()["kept"] is False  # no stop word
    assert quality.judge(df, thresholds=[("n_words", None, 10)]).first()["kept"] is True
    with pytest.raises(ValueError):
        quality.judge(df, thresholds=[("nothing", 1, 2)])


def test_no_user_function_and_no_shuffle(spark):
    plan = quality.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
