"""Training records: series, best evaluation, early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the label of a position that bears no loss.
MASKED = -100
LOGGED = ("loss", "eval_loss", "learning_rate", "epoch")


def kept_records(logs: DataFrame) -> DataFrame:
    """step and the logged values; records with a step alone go."""
    return logs.select("step", *[F.col(c).cast("double").alias(c) for c in LOGGED]).where(F.coalesce(*LOGGED).isNotNull())


def series(logs: DataFrame, value: str) -> DataFrame:
    """step and value where there is one."""
    return logs.select("step", F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())


def best_evaluation(logs: DataFrame) -> DataFrame:
    """One row: the step of the least eval_loss (the earliest on ties), and it."""
    evals = series(logs, "eval_loss")
    return evals.agg(F.min(F.struct("eval_loss", "step")).alias("m")).select("m.step", "m.eval_loss")


def early_stop(logs: DataFrame, patience: int = 3) -> DataFrame:
    """One row, step: where so many evaluations in a row had not improved the least loss before; null if never.

    A run's evaluations are few (one each epoch), so one ordered window takes them.
    """
    w = Window.orderBy("step")
    evals = series(logs, "eval_loss").withColumn("least", F.min("eval_loss").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = evals.withColumn("better", F.col("least").isNull() | (F.col("eval_loss") < F.col("least"))).withColumn("run", F.sum(F.col("better").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    waited = marked.withColumn("waited", F.sum((~F.col("better")).cast("int")).over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return waited.where(F.col("waited") >= patience).agg(F.min("step").alias("step"))


def kept_checkpoints(checkpoints: DataFrame, keep: int = 2) -> DataFrame:
    """The last of the checkpoints by step."""
    return checkpoints.orderBy(F.col("step").desc()).limit(keep)


def unmasked(labels: Column, pad: int) -> Column:
    """Label ids that can be decoded: masked ones become the padding id."""
    return F.transform(labels, lambda x: F.when(x == MASKED, F.lit(pad)).otherwise(x))
