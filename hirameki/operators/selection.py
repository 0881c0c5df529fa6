"""The best candidate that is allowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirameki.errors import DataContractError


def with_samples(rows: DataFrame, samples: DataFrame, index: str = "index", candidates: str = "candidates") -> DataFrame:
    """rows with their candidates; a row without a sample, or a sample without a list, is an error. Samples of no row are ignored."""
    joined = rows.join(samples.select(index, candidates, F.lit(True).alias("_has")), index, "left")
    lacking = joined.where(F.col("_has").isNull() | F.col(candidates).isNull()).select(index).limit(5).collect()
    if lacking:
        raise DataContractError(f"no candidates for {index} {[r[0] for r in lacking]}")
    return joined.drop("_has")


def best_candidate(candidates: Column, allowed: Callable[[Column], Column]) -> Column:
    """Of an array of {text, score}: the allowed one of the highest score, the earliest on ties.

    Candidates without a text are passed over. A null or NaN score is taken only if no allowed candidate before or after
    has a number, then the first allowed one. Null if none is allowed. One row's array: no shuffle, no window.
    """
    usable = F.filter(candidates, lambda c: c["text"].isNotNull() & allowed(c["text"]))
    number = "struct<text:string,score:double>"

    def better(best: Column, c: Column) -> Column:
        score, own = F.nanvl(c["score"], F.lit(None).cast("double")), F.nanvl(best["score"], F.lit(None).cast("double"))
        first = best["text"].isNull()
        return F.when(first | (score.isNotNull() & (own.isNull() | (score > own))), F.struct(c["text"].alias("text"), c["score"].cast("double").alias("score")).cast(number)).otherwise(best)

    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("score")).cast(number)
    return F.aggregate(usable, nothing, better, lambda b: F.when(b["text"].isNotNull(), b))
