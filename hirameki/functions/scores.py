"""Scores that models leave as arrays, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_logprob(logprobs: Column) -> Column:
    return F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x)


def average_logprob(total: Column, count: Column) -> Column:
    """total / count; infinity (not minus) for no tokens."""
    return F.when(count == 0, F.lit(float("inf"))).otherwise(total / count)


def perplexity(total: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(float("inf"))).otherwise(F.exp(-total / count))


def perplexity_change(source: Column, target: Column) -> Column:
    """target - source; NaN for two infinities."""
    return target - source


def sequence_logprob(logprobs: Column, ids: Column, end_id: int) -> Column:
    """Sum over the steps up to the first end id, with it; ids begin with the decoder's start. Null without scores."""
    steps = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    at = F.array_position(steps, F.lit(end_id))
    n = F.when(at > 0, at.cast("int")).otherwise(F.size(logprobs))
    return F.when(logprobs.isNotNull() & (F.size(logprobs) > 0), total_logprob(F.slice(logprobs, F.lit(1), n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, each scaled to length one (but not by less than 1e-12)."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps, component by component."""
    first = F.transform(F.try_element_at(vectors, F.lit(1)), lambda _: F.lit(0.0))
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(kept, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def percentile(value: Column, p: float) -> Column:
    """Exact, linear between ranks; the least for p <= 0, the largest for p >= 1, NaN for no rows."""
    return F.coalesce(F.percentile(value, F.lit(float(min(max(p, 0.0), 1.0)))), F.lit(float("nan")))


def percentiles(value: Column, shares: list[float]) -> Column:
    """A map from each share, as text, to its percentile."""
    return F.create_map(*[c for p in shares for c in (F.lit(str(p)), percentile(value, p))])


def below(similarity: Column, threshold: float | None) -> Column:
    """Whether it is strictly below; null without a threshold."""
    return F.lit(None).cast("boolean") if threshold is None else similarity < threshold


def badge(value: Column, bad: Column) -> Column:
    return F.when(value.isNull(), "na").when(bad, "bad").otherwise("ok")


def fluency_badge(ppl: Column, threshold: float) -> Column:
    return badge(ppl, ppl >= threshold)


def meaning_badge(similarity: Column, threshold: float) -> Column:
    return badge(similarity, similarity <= threshold)
