"""Simplification metrics as columns, and corpus means over them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from hirameki.functions import text as T
from hirameki.functions.text import let

#: Parts the tokens of an n-gram.
JOINT = "\x1f"
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"char": T.characters, "whitespace": T.white_space_tokens}


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams, each one string; none if there are too few tokens."""
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), JOINT))


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Contiguous n-grams of hashed tokens, each a 64-bit hash: that two unequal ones share one is as good as impossible."""
    if n == 1:
        return hashes
    places = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * precision * recall / both)


def _part(mine: Column, theirs: Column, shared: Column) -> Column:
    """F1 of two sets of these sizes that share so many."""
    return f1(shared / F.greatest(F.lit(1), mine), shared / F.greatest(F.lit(1), theirs))


def _by_order(source: Column, prediction: Column, reference: Column, n: int) -> Column:
    """Sum of keep, add and delete F1 of one order of n-grams of hashed tokens: all follow from the sizes of intersections."""
    sets = F.struct(*[F.array_distinct(gram_hashes(x, n)).alias(k) for k, x in (("s", source), ("p", prediction), ("r", reference))])

    def sizes(x: Column) -> Column:
        def counted(sp: Column) -> Column:
            of = {"sp": F.size(sp), "sr": F.size(F.array_intersect(x["s"], x["r"])), "pr": F.size(F.array_intersect(x["p"], x["r"])), "spr": F.size(F.array_intersect(sp, x["r"]))}
            return F.struct(*[F.size(x[k]).alias(k) for k in "spr"], *[v.alias(k) for k, v in of.items()])

        return let(F.array_intersect(x["s"], x["p"]), counted)

    def parts(n: Column) -> Column:
        kept = _part(n["sp"], n["sr"], n["spr"])
        added = _part(n["p"] - n["sp"], n["r"] - n["sr"], n["pr"] - n["spr"])
        dropped = _part(n["s"] - n["sp"], n["s"] - n["sr"], n["s"] - n["sp"] - n["sr"] + n["spr"])
        return kept + added + dropped

    return let(sets, lambda x: let(sizes(x), parts))


def simplification(source: Column, prediction: Column, reference: Column) -> Column:
    """Mean of keep, add and delete F1 over sets of 1- to 4-grams, 0 to 1; 0 if any side has no token. All three are token arrays."""

    def score(x: Column) -> Column:
        total = sum((_by_order(x["s"], x["p"], x["r"], n) for n in range(2, 5)), _by_order(x["s"], x["p"], x["r"], 1))
        return F.when((F.size(x["s"]) == 0) | (F.size(x["p"]) == 0) | (F.size(x["r"]) == 0), F.lit(0.0)).otherwise(total / 12)

    return let(F.struct(token_hashes(source).alias("s"), token_hashes(prediction).alias("p"), token_hashes(reference).alias("r")), score)


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of its table is one integer, a bit per token of b."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    row = 0
    for x in a:
        both = row | places.get(x, 0)
        row = both & ~(both - (row << 1 | 1))
    return row.bit_count()


def _batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_longest_common(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def longest_common(a: Column, b: Column) -> Column:
    """Of two arrays of texts. A fold over arrays would interpret each cell of the table, so this crosses to Python in batches."""
    return F.pandas_udf(_batch, IntegerType())(a, b)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of rouge_tokens; 0 where either has none."""
    p, r = rouge_tokens(F.coalesce(prediction, F.lit(""))), rouge_tokens(F.coalesce(reference, F.lit("")))
    common = longest_common(p, r)
    return F.when(common == 0, F.lit(0.0)).otherwise(f1(common / F.size(p), common / F.size(r)))


def numbered(grams: Column) -> Column:
    """Hashes of n-gram hashes with their number among their equals, so that sets of these count like bags. One sort, then linear."""

    def runs(g: Column) -> Column:
        starts = F.filter(F.transform(g, lambda x, i: F.when((i == 0) | (F.get(g, i - 1) != x), i)), lambda i: i.isNotNull())

        def tagged(s: Column) -> Column:
            ends = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.size(g)))
            return F.flatten(F.zip_with(s, ends, lambda lo, hi: F.transform(F.sequence(F.lit(1), hi - lo), lambda j: F.xxhash64(F.get(g, lo), j))))

        return F.when(F.size(g) > 0, let(starts, tagged)).otherwise(F.array().cast("array<bigint>"))

    return let(F.array_sort(grams), runs)


def bleu(pairs: DataFrame, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """One row, bleu: corpus BLEU of token arrays (0 to 100), one reference, zero counts smoothed by halving; null for no rows.

    Each row gives its clipped matches; sums of those and of lengths are one aggregation without shuffled n-grams.
    """
    pairs = pairs.select(token_hashes(F.col(prediction)).alias("p"), token_hashes(F.col(reference)).alias("r"))
    p, r = F.col("p"), F.col("r")
    columns = [F.size(p).alias("length_p"), F.size(r).alias("length_r")]
    for n in range(1, order + 1):
        matched = F.size(F.array_intersect(numbered(gram_hashes(p, n)), numbered(gram_hashes(r, n))))
        columns += [matched.alias(f"m{n}"), F.greatest(F.size(p) - (n - 1), F.lit(0)).alias(f"t{n}")]
    sums = pairs.select(*columns).agg(F.count("*").alias("rows"), *[F.sum(c).cast("double").alias(c) for c in ["length_p", "length_r", *(f"{k}{n}" for n in range(1, order + 1) for k in "mt")]])
    halvings, logs, counted = F.lit(0), F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        halvings = halvings + ((m == 0) & (t > 0)).cast("int")
        precision = F.when(m > 0, 100 * m / t).otherwise(100 / (F.pow(F.lit(2.0), halvings) * t))
        logs = logs + F.when(t > 0, F.ln(precision)).otherwise(0.0)
        counted = counted + (t > 0).cast("int")
    brevity = F.when(F.col("length_p") >= F.col("length_r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("length_r") / F.col("length_p")))
    score = F.when((counted < order) | (F.col("m1") == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs / order))
    return sums.select(F.when(F.col("rows") > 0, score).alias("bleu"))


def corpus_means(pairs: DataFrame, source: str, prediction: str, reference: str, tokenizer: str = "char", tokens: tuple[str, str, str] | None = None) -> DataFrame:
    """One row of means over triples of texts: sari, rouge_l, copy_rate, mean lengths and length_ratio; zeros for no rows.

    tokens: columns that hold the three texts' tokens already (an analyzer's surfaces).
    """
    cut = TOKENIZERS[tokenizer]
    s, p, r = (F.col(c) for c in tokens) if tokens else (cut(F.coalesce(F.col(c), F.lit(""))) for c in (source, prediction, reference))
    rows = pairs.select(s.alias("s"), p.alias("p"), r.alias("r"), F.col(prediction).alias("pt"), F.col(reference).alias("rt"), (F.col(source) == F.col(prediction)).alias("copied"))
    rows = rows.select(simplification(F.col("s"), F.col("p"), F.col("r")).alias("sari"), rouge_l(F.col("pt"), F.col("rt")).alias("rouge"), F.col("copied").cast("double").alias("copied"), F.size("p").alias("np"), F.size("r").alias("nr"))

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    return rows.agg(
        F.count("*").alias("rows"), mean("sari").alias("sari"), mean("rouge").alias("rouge_l"), mean("copied").alias("copy_rate"), mean("np").alias("mean_prediction_length"), mean("nr").alias("mean_reference_length"),
        (mean("np") / F.greatest(F.lit(1.0), mean("nr"))).alias("length_ratio"),
    )
