import random
from collections import Counter

import numpy as np

from hirameki.llm import langid

WORDS = {"aa": ["thing", "other", "wher", "ough", "and"], "bb": ["schei", "ung", "keit", "über", "und"], "cc": ["eaux", "être", "ment", "que", "et"]}


def rows(n, rnd):
    return [(lang, " ".join("".join(rnd.choices(w, k=rnd.randint(1, 3))) for _ in range(rnd.randint(3, 40))), i) for lang, w in WORDS.items() for i in range(n)]


def test_held_out_accuracy_and_edge_cases(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([*rows(60, rnd), (None, "thing", 0), ("aa", None, 0)], "lang string, text string, score long")
    model = langid.fit(df)
    assert model.languages == ["aa", "bb", "cc"] and (model.fp < 0.1).all()
    held = rows(40, rnd)
    edge = [(None, t, i) for i, t in enumerate([None, "", "123 !?", "жизнь", "x", "und"])]
    got = langid.predict(spark.createDataFrame([*held, *edge], "lang string, text string, score long"), model).collect()
    found = [r["lang_pred"] == r["lang"] for r in got if r["lang"]]
    assert np.mean(found) > 0.97 and len(got) == len(held) + len(edge)
    by_text = {r["text"]: r for r in got}
    assert all(by_text[t]["lang_pred"] == "und" and by_text[t]["score"] == 0 for t in (None, "", "123 !?"))
    assert by_text["жизнь"]["lang_pred"] in model.languages and by_text["und"]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_learned_and_empty_tables(spark):
    none = spark.createDataFrame([], "lang string, text string")
    model = langid.fit(none)
    assert langid.predict(spark.createDataFrame([("aa", "abc")], "lang string, text string"), model).first()["lang_pred"] == "und"
    assert langid.predict(none, model).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(rows(50, random.Random(2)), "lang string, text string, score long")
    a, b = langid.fit(df.repartition(1), per_language=5), langid.fit(df.repartition(7), per_language=5)
    assert (a.places == b.places).all()


def test_copies_are_one_text(spark):
    """A text that is repeated counts once, so that it can't be the whole sample."""
    rnd = random.Random(6)
    some = [(lang, text) for lang, text, _ in rows(40, rnd)]
    df = spark.createDataFrame(some + [some[0]] * 3000 + [some[-1]] * 500, "lang string, text string")
    a, b = langid.fit(df, per_language=30), langid.fit(spark.createDataFrame(some, "lang string, text string"), per_language=30)
    assert a.languages == ["aa", "bb", "cc"] and (a.places == b.places).all()


def test_predictions_against_sets(spark):
    """The same rule with a set of n-grams for each language in place of the filter."""
    rnd = random.Random(5)
    learned = rows(60, rnd)
    model = langid.fit(spark.createDataFrame(learned, "lang string, text string, score long"))
    counts = {lang: Counter(g for of, t, _ in learned if of == lang for g in list_ngrams(t)) for lang in WORDS}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    sets = {lang: {g for g, x in s.items() if x >= 0.2 * max(o.get(g, 0) for o in share.values())} for lang, s in share.items()}
    texts = [t for _, t, _ in rows(40, rnd)]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        grams = list_ngrams(text)
        each = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
        best = max(each.values())
        assert each[name] >= best - 0.01 and abs(score - best) < 0.02


def list_ngrams(text):
    points = [" "]
    for c in text.lower() + " ":
        if c.isalpha():
            points.append(c)
        elif points[-1] != " ":
            points.append(" ")
    return ["".join(points[i : i + n]) for n in langid.SIZES for i in range(len(points) - n + 1)]


def brute_ngrams(text):
    points, out = [" "], set()
    for c in text.lower() + " ":
        if c.isalpha():
            points.append(c)
        elif points[-1] != " ":
            points.append(" ")
    for n in langid.SIZES:
        out |= {"".join(points[i : i + n]) for i in range(len(points) - n + 1)}
    return out


def test_ngrams_by_text():
    texts = ["", "Ab cd", "1x", "ÀÉ--b", "no\n\nno", "İstanbul", "ab"]
    _, owner, has = langid.ngrams(texts)
    alone = [len(np.unique(langid.ngrams([t])[0])) for t in texts]
    assert alone == [len(brute_ngrams(t)) for t in texts]
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    hashes, owner, _ = langid.ngrams(texts)
    assert [len(np.unique(hashes[owner == i])) for i in range(len(texts))] == alone
