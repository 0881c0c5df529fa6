"""Candidates and scores from model providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirameki.errors import DataContractError
from hirameki.functions import scores
from hirameki.providers import Provider, provided

CANDIDATES = "array<struct<text:string,score:double>>"


def check_sampling(sequences: int, beams: int = 1, sampling: bool = True) -> None:
    if sequences < 1:
        raise DataContractError("one sequence at least")
    if not sampling and sequences > beams:
        raise DataContractError("without sampling, no more sequences than beams")


class Grouped:
    """A model that gives `sequences` (text, score) pairs for each text, all in one list, as a provider of candidates."""

    def __init__(self, model: Callable[[list[str]], list[tuple[str, float | None]]], sequences: int):
        check_sampling(sequences)
        self.model, self.sequences = model, sequences

    def __call__(self, texts: list[str | None]) -> list:
        flat = self.model([t or "" for t in texts])
        if len(flat) != len(texts) * self.sequences:
            raise DataContractError(f"{len(flat)} sequences for {len(texts)} texts of {self.sequences} each")
        return [[{"text": t, "score": s} for t, s in flat[i : i + self.sequences]] for i in range(0, len(flat), self.sequences)]


def sampled(rows: DataFrame, text: str, model: Callable[[], Callable], sequences: int) -> DataFrame:
    """rows with candidates."""
    check_sampling(sequences)
    return provided(rows, text, "candidates", CANDIDATES, lambda: Grouped(model(), sequences))


def simplified(rows: DataFrame, text: str, factory: Callable[[], Provider], output: str = "caption") -> DataFrame:
    """rows with the output of a text-to-text model; the field is replaced if it is there."""
    made = provided(rows, text, "_simplified", "string", factory)
    return made.withColumn(output, F.col("_simplified")).drop("_simplified")


def scored(rows: DataFrame, text: str, factory: Callable[[], Provider], prefix: str = "lm_") -> DataFrame:
    """rows with total_logprob, avg_logprob and ppl of a provider of token log probabilities."""
    made = provided(rows, text, "_logprobs", "array<double>", factory)
    total, n = scores.total_logprob(F.col("_logprobs")), F.size("_logprobs")
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], total.alias(f"{prefix}total_logprob"), scores.average_logprob(total, n).alias(f"{prefix}avg_logprob"), scores.perplexity(total, n).alias(f"{prefix}ppl"))


def fluency(rows: DataFrame, source: str, target: str, factory: Callable[[], Provider]) -> DataFrame:
    """rows with lm_source_ppl, lm_target_ppl and lm_delta_ppl."""
    out = rows
    for field, name in ((source, "lm_source_ppl"), (target, "lm_target_ppl")):
        made = provided(out, field, "_logprobs", "array<double>", factory)
        out = made.withColumn(name, scores.perplexity(scores.total_logprob(F.col("_logprobs")), F.size("_logprobs"))).drop("_logprobs")
    return out.withColumn("lm_delta_ppl", scores.perplexity_change(F.col("lm_source_ppl"), F.col("lm_target_ppl")))


def meaning(rows: DataFrame, source: str, target: str, factory: Callable[[], Provider], threshold: float | None = None) -> DataFrame:
    """rows with semantic_similarity of a provider's vectors, and semantic_below_threshold if there is a threshold."""
    one = provided(rows, source, "_a", "array<double>", factory)
    two = provided(one, target, "_b", "array<double>", factory).withColumn("semantic_similarity", scores.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return two if threshold is None else two.withColumn("semantic_below_threshold", scores.below(F.col("semantic_similarity"), threshold))


def thresholds(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row, thresholds: a map from each share, as text, to the exact percentile."""
    return rows.agg(scores.percentiles(F.col(value), shares).alias("thresholds"))
