import random
import re

import pytest
from pyspark.sql import functions as F

from hirameki.errors import DataContractError
from hirameki.functions import metrics, morphology, scores
from hirameki.functions import text as T
from hirameki.functions.vocabulary import Vocabulary, covered, segments, uncovered_runs
from hirameki.plans import catalog

VOCABULARIES = [["a", "ab", "b", "ba", "abc"], ["aa", "aab", "b"], ["猫", "文字", "です", "で", "す", "文"], ["x"]]


def texts(tokens, n=150):
    rnd = random.Random(len(tokens))
    letters = sorted(set("".join(tokens))) + ["?", "😀"]
    return ["", *("".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(n)), *("".join(rnd.choices(tokens, k=rnd.randint(1, 6))) for _ in range(n))]


def brute_covered(text, tokens):
    reach = [True]
    for k in range(1, len(text) + 1):
        reach.append(any(len(t) <= k and reach[k - len(t)] and text[k - len(t) : k] == t for t in tokens))
    return reach[-1]


def brute_runs(text, tokens):
    """Fewest unknown characters; at equal cost the edge with the earlier start."""
    best = [(0, [], False)]
    for k in range(1, len(text) + 1):
        options = []
        for i in range(k):
            if text[i:k] in tokens:
                options.append((best[i][0], i, best[i][1], False))
        cost, runs, unknown = best[k - 1]
        grown = [*runs[:-1], runs[-1] + text[k - 1]] if unknown else [*runs, text[k - 1]]
        options.append((cost + 1, k - 0.5, grown, True))
        c, _, r, u = min(options, key=lambda o: o[:2])
        best.append((c, r, u))
    return best[-1][1]


def brute_segments(text, tokens):
    def fewest(end, memo={}):
        if end == 0:
            return []
        found = [(len(s) + 1, i, [*s, text[i:end]]) for i in range(end) if text[i:end] in tokens and (s := fewest(i)) is not None]
        return min(found)[2] if found else None

    if not text:
        return []
    for i in range(len(text)):
        if text[i:] in tokens and (head := fewest(i)) is not None:
            return [*head, text[i:]]
    return None


@pytest.mark.parametrize("tokens", VOCABULARIES)
def test_segmentation_against_brute_force(spark, tokens):
    v = Vocabulary(tokens)
    rows = spark.createDataFrame([(t,) for t in texts(tokens)], "t string")
    t = F.col("t")
    for r in rows.select("t", covered(t, v).alias("c"), uncovered_runs(t, v).alias("u"), segments(t, v).alias("s")).collect():
        assert (r["c"], r["u"], r["s"]) == (brute_covered(r["t"], tokens), brute_runs(r["t"], tokens), brute_segments(r["t"], tokens)), r["t"]
        assert r["c"] == (r["s"] is not None) == (not r["u"])


def test_vocabulary_contract():
    with pytest.raises(DataContractError):
        Vocabulary(["", ""])
    assert Vocabulary(["b", "b", "ab"]).longest == 2


def test_white_space(spark):
    spaces = "".join(chr(c) for c in range(0x10000) if chr(c).isspace() and not 0xD800 <= c < 0xE000)
    r = spark.createDataFrame([("a" + spaces + "b",)], "t string").select(T.without_white_space(F.col("t")).alias("x"), T.white_space_tokens(F.col("t")).alias("w"), T.stripped(F.concat(F.lit("　"), "t", F.lit("\x1c"))).alias("s")).first()
    assert (r["x"], r["w"], r["s"]) == ("ab", ["a", "b"], "a" + spaces + "b")


def test_artifacts(spark):
    rows = {"白い物と物々と物物ものする": "白いものとものとものする", "物": "物", "赤き物": "赤き物", "物物物する": "する"}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", T.mend_artifacts(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == rows


def brute_sari(s, p, r):
    if not s or not p or not r:
        return 0.0

    def score(a, b):
        hit = len(a & b)
        x, y = hit / max(1, len(a)), hit / max(1, len(b))
        return 2 * x * y / (x + y) if x + y else 0.0

    total = 0.0
    for n in range(1, 5):
        a, b, c = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (s, p, r))
        total += (score(a & b, a & c) + score(b - a, c - a) + score(a - b, a - c)) / 3
    return total / 4


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_metrics_against_brute_force(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choices("ab c", k=rnd.randint(0, 12))) for _ in range(240)]
    rows = [tuple(words[i : i + 3]) for i in range(0, 240, 3)] + [("猫犬", "猫犬", "猫犬"), ("", "a", "a"), ("a1 b", "A1", "a1 B")]
    df = spark.createDataFrame(rows, "s string, p string, r string")
    cut = [T.characters(F.col(c)) for c in "spr"]
    for r in df.select("*", metrics.simplification(*cut).alias("m"), metrics.rouge_l(F.col("p"), F.col("r")).alias("l")).collect():
        assert r["m"] == pytest.approx(brute_sari(list(r["s"]), list(r["p"]), list(r["r"])))
        a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (r["p"], r["r"]))
        common = brute_common(a, b)
        assert r["l"] == pytest.approx(2 * common / (len(a) + len(b)) if common else 0.0)
    same = df.where("s = '猫犬'").select(metrics.simplification(*cut).alias("m"), metrics.rouge_l(F.col("p"), F.col("r")).alias("l")).first()
    assert same["m"] == pytest.approx(1 / 6) and same["l"] == 0


def test_bleu(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on a mat"), ("a b c d e", "a b c d e f")], "p string, r string")
    cut = df.select(T.white_space_tokens(F.col("p")).alias("p"), T.white_space_tokens(F.col("r")).alias("r"))
    assert metrics.bleu(cut, "p", "r").first()["bleu"] == pytest.approx(0.9131007162822624 * 100 * (10 / 11 * 7 / 9 * 5 / 7 * 3 / 5) ** 0.25)
    assert metrics.bleu(cut.limit(0), "p", "r").first()["bleu"] is None


def test_scores(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-2.0, 4, [0.5, -1.0, -2.0, -4.0], [9, 5, 2, 7, 7]), (0.0, 0, None, [9]), (-1.0, 1, [-1.0], [9, 2])], "t double, n int, lp array<double>, ids array<int>")
    got = df.select(scores.average_logprob(F.col("t"), F.col("n")).alias("a"), scores.perplexity(F.col("t"), F.col("n")).alias("p"), scores.sequence_logprob(F.col("lp"), F.col("ids"), 2).alias("s")).collect()
    assert [r["a"] for r in got] == [-0.5, inf, -1.0] and got[0]["p"] == pytest.approx(2.718281828 ** 0.5) and got[1]["p"] == inf
    assert [r["s"] for r in got] == [-0.5, None, -1.0]
    assert str(spark.range(1).select(scores.perplexity_change(F.lit(inf), F.lit(inf)).alias("x")).first()["x"]) == "nan"
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    one = values.agg(scores.percentile(F.col("x"), 0.5).alias("m"), scores.percentile(F.col("x"), -1).alias("lo"), scores.percentile(F.col("x"), 2).alias("hi"), scores.percentiles(F.col("x"), [0.95]).alias("map")).first()
    assert (one["m"], one["lo"], one["hi"]) == (2.5, 1.0, 10.0) and one["map"]["0.95"] == pytest.approx(8.95)
    assert str(values.limit(0).agg(scores.percentile(F.col("x"), 0.5).alias("m")).first()["m"]) == "nan"
    v = spark.createDataFrame([([[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert v.select(scores.masked_mean(F.col("v"), F.col("m")).alias("x")).first()["x"] == [2.0, 2.0]


def test_morpheme_rules(spark):
    m = catalog.morpheme
    v = Vocabulary(["猫", "あか", "赤い", "0", "2", "ある"])
    rows = [(m(surface="猫"), "猫", True), (m(surface="赤", lemma="赤"), "赤い", False), (m(surface="零", lemma="零"), "0", False), (m(surface="二", lemma="二"), "2", True), (m(surface="朱", lemma="朱", kanaBase="アカ"), "あか", True), (m(surface="有る", lemma="有る"), "ある", False), (m(surface="鳥"), "鳥", False)]
    df = spark.createDataFrame([(x, n, k) for x, n, k in rows], f"m {morphology.MORPHEME}, n string, known boolean")
    got = df.select("n", "known", morphology.normalized_to(F.col("m"), v, kana=True, numbers=True).alias("x"), (F.size(morphology.missing_morphemes(F.array("m"), v)) == 0).alias("k")).collect()
    assert all(r["x"] == r["n"] for r in got) and [r["k"] for r in got] == [True, False, True, True, True, False, False]
    plain = spark.createDataFrame([(m(surface="三", lemma="三", kanaBase="サン"),)], f"m {morphology.MORPHEME}")
    assert plain.select(morphology.normalized(F.col("m"), kana=True, numbers=True).alias("x"), morphology.normalized(F.col("m"), numbers=True).alias("y")).first().asDict() == {"x": "さん", "y": "3"}


def test_verb_classes(spark):
    m = catalog.morpheme
    rows = [("見る", None, "godan"), ("食べる", None, "ichidan"), ("走る", [m(surface="走る", pos1="動詞", cType="五段-ラ行")], "godan"), ("着る", [m(surface="着る", pos="動詞,一般", cType="上一段-カ行")], "ichidan"), ("犬る", [m(surface="犬る", pos1="名詞")], None), ("する", [m(surface="x", pos1="名詞")], "suru")]
    df = spark.createDataFrame(rows, f"l string, a array<{morphology.MORPHEME}>, want string")
    got = df.select("want", F.when(F.col("a").isNull(), morphology.verb_class(F.col("l"))).otherwise(morphology.verb_class(F.col("l"), F.col("a"))).alias("x")).collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_long_captions_take_linear_time(spark):
    import random
    import time

    v, t = Vocabulary(["ab", "abc", "cb", "a", "ccc"]), "".join(random.Random(1).choices("abcd", k=60_000))
    tiled = "abcaab" * 10_000
    df = spark.createDataFrame([(t, tiled)], "t string, u string")
    began = time.time()
    row = df.select(covered(F.col("t"), v).alias("c"), uncovered_runs(F.col("t"), v).alias("r"), segments(F.col("t"), v).alias("s"), covered(F.col("u"), v).alias("d"), segments(F.col("u"), v).alias("w")).first()
    assert time.time() - began < 60
    assert (row["c"], row["s"], row["d"]) == (False, None, True) and "".join(row["w"]) == tiled and set(row["w"]) <= {"ab", "abc", "a"}
    assert 0 < sum(map(len, row["r"])) <= len(t) and all(x in t for x in row["r"])
