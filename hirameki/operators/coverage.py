"""Vocabulary coverage: verdicts, pass and fail sides, frequencies of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirameki.errors import DataContractError
from hirameki.functions import morphology as M
from hirameki.functions import text as T
from hirameki.functions import vocabulary as V


def with_known(rows: DataFrame, text: Column, tokens: DataFrame, into: str = "_known") -> tuple[DataFrame, V.RowVocabulary]:
    """rows with into, the tokens of a table (token) that occur in the text without its white space, and the vocabulary that it makes.

    Each distinct text's pieces of the tokens' lengths meet the table by value, so the table may have any size; how many
    pieces a text has is its length times the number of lengths. A null text has no tokens; no token at all is an error.
    """
    lengths = sorted((r[0] for r in tokens.where("token <> ''").select(F.length("token")).distinct().collect()), reverse=True)  # numbers up to the longest token's
    if not lengths:
        raise DataContractError("the vocabulary is empty")
    keyed = rows.withColumn("_text", T.without_white_space(text)).withColumn("_key", F.md5("_text"))

    def pieces(chars: Column) -> Column:
        def of(length: int) -> Column:
            at = F.when(F.size(chars) >= length, F.sequence(F.lit(1), F.size(chars) - length + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.array_join(F.slice(chars, i, F.lit(length)), ""))

        return F.array_distinct(F.concat(*[of(n) for n in lengths]))

    each = keyed.where("_text <> ''").select("_key", "_text").dropDuplicates(["_key"]).select("_key", F.explode(T.let(T.characters(F.col("_text")), pieces)).alias("token"))
    found = each.join(tokens.select("token"), "token", "left_semi").groupBy("_key").agg(F.array(*[F.collect_list(F.when(F.length("token") == n, F.col("token"))) for n in lengths]).alias(into))
    joined = keyed.join(found, "_key", "left").withColumn(into, F.coalesce(into, F.array().cast("array<array<string>>")))
    return joined.drop("_key", "_text"), V.RowVocabulary(lengths, F.col(into))


def verdict(text: Column, vocabulary: V.Tokens, morphemes: Column | None = None, mode: str = "char") -> Column:
    """Whether a caption is covered. char: its characters without white space are tiled, or else no morpheme is missing (if there are morphemes); fugashi: no morpheme is missing."""
    missing = None if morphemes is None else F.size(M.missing_morphemes(morphemes, vocabulary)) == 0
    if mode == "fugashi":
        if missing is None:
            raise ValueError("this mode needs morphemes")
        return missing
    tiled = V.covered(T.without_white_space(text), vocabulary)
    return tiled if missing is None else F.when(tiled, F.lit(True)).otherwise(missing)


def missing_tokens(text: Column, vocabulary: V.Tokens, morphemes: Column | None = None) -> Column:
    """By morphemes where there are such, else the unknown runs of the characters."""
    return V.uncovered_runs(T.without_white_space(text), vocabulary) if morphemes is None else M.missing_morphemes(morphemes, vocabulary)


def sides(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that fail; every row is in exactly one (null fails)."""
    flagged = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.where("_ok").drop("_ok"), flagged.where("NOT _ok").drop("_ok")


def pass_rate(rows: DataFrame, ok: Column) -> DataFrame:
    """One row: total, passed, failed, pass_rate (0 for no rows)."""
    counted = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"))
    return counted.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0).alias("pass_rate"))


def frequencies(rows: DataFrame, tokens: Column, top: int | None = None) -> DataFrame:
    """token and count over arrays of tokens, each occurrence counted; the most frequent first, then by code points."""
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    ranked = counts.orderBy(F.col("count").desc(), "token")
    return ranked if top is None else ranked.limit(top)


def segmented(tokens: Column, vocabulary: V.Vocabulary) -> Column:
    """Tokens, those that aren't in the vocabulary but are tiled by it as their segments."""
    return F.flatten(F.transform(tokens, lambda t: F.when(vocabulary.has(t), F.array(t)).otherwise(F.coalesce(V.segments(t, vocabulary), F.array(t)))))


def token_stats(rows: DataFrame, tokens: Column, known: DataFrame | None = None) -> DataFrame:
    """One row: total_captions, total_tokens, unique_tokens, and captions_with_outside_tokens with its rate (0 for no rows).

    known: a table of tokens; of each caption, one token outside it is enough (tokens that a vocabulary tiles aren't, if
    tokens are segmented()). Tokens meet the table by distinct token, so the table may be large.
    """
    rows = rows.select(F.monotonically_increasing_id().alias("caption"), tokens.alias("tokens"))
    each = rows.select("caption", F.explode("tokens").alias("token"))
    parts = rows.agg(F.count("*").alias("total_captions"))
    parts = parts.unionByName(each.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_tokens"), F.count("*").alias("unique_tokens")), allowMissingColumns=True)
    names = ["total_captions", "total_tokens", "unique_tokens"]
    if known is not None:
        outside = each.join(known.select("token").distinct(), "token", "left_anti").select("caption").distinct()
        names.append("captions_with_outside_tokens")
        parts = parts.unionByName(outside.agg(F.count("*").alias(names[-1])), allowMissingColumns=True)
    out = parts.agg(*[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in names])
    if known is None:
        return out
    rate = F.when(F.col("total_captions") > 0, F.col("captions_with_outside_tokens") / F.col("total_captions")).otherwise(0.0)
    return out.withColumn("captions_with_outside_tokens_rate", rate)


def normalized_tokens(morphemes: Column, normalize: bool = False, vocabulary: V.Vocabulary | None = None, lemma: bool = True, kana: bool = False, numbers: bool = False) -> Column:
    """Tokens to count: surfaces or base forms as they are, or their normal forms (kana and numbers only then); empty ones go."""

    def one(m: Column) -> Column:
        if not normalize:
            return M.base_form(m) if lemma else m["surface"]
        return M.normalized(m, lemma, kana, numbers) if vocabulary is None else M.normalized_to(m, vocabulary, lemma, kana, numbers)

    return F.filter(F.transform(morphemes, one), lambda t: t != "")


def outside_of_failed(tokens: Column, vocabulary: V.Vocabulary) -> Column:
    """Tokens that aren't in the vocabulary and aren't tiled by it."""
    return F.filter(tokens, lambda t: (t != "") & ~vocabulary.has(t) & ~V.covered(t, vocabulary))


def coverage_summary(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: of tokens with counts, how many and how often, in the list and not."""
    flagged = counts.join(listed.select("token").distinct().withColumn("listed", F.lit(True)), "token", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    zero = F.lit(0).cast("long")
    return flagged.agg(
        F.count("*").alias("unique_tokens"), F.coalesce(F.sum("count"), zero).alias("total_tokens"), F.count_if("listed").alias("unique_listed"), F.coalesce(F.sum(F.when(F.col("listed"), F.col("count"))), zero).alias("total_listed"),
        F.count_if(~F.col("listed")).alias("unique_not_listed"), F.coalesce(F.sum(F.when(~F.col("listed"), F.col("count"))), zero).alias("total_not_listed"),
    )
