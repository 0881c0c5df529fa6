"""Structured Streaming forms of the file-append stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirameki.functions.vocabulary import Vocabulary
from hirameki.operators.coverage import missing_tokens, verdict


def captions(spark: SparkSession, folder: str, schema: str = "index BIGINT, id BIGINT, image_id BIGINT, caption STRING, at TIMESTAMP") -> DataFrame:
    """JSON lines as they are appended to a folder as files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(folder)


def checked(stream: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Captions with ok and missing_tokens; stateless."""
    ok = verdict(F.col("caption"), vocabulary)
    return stream.withColumn("ok", ok).withColumn("missing_tokens", F.when(~F.col("ok"), missing_tokens(F.col("caption"), vocabulary)))


def missing_by_window(stream: DataFrame, vocabulary: Vocabulary, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of missing tokens by window of event time; state goes once the watermark has passed a window."""
    tokens = checked(stream, vocabulary).withWatermark("at", late).select("at", F.explode("missing_tokens").alias("token"))
    return tokens.groupBy(F.window("at", window).alias("window"), "token").agg(F.count("*").alias("count"))
