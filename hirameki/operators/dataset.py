"""Pairs and shards: rates, seeded split, shard filter, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirameki.errors import DataContractError


def passthrough_rates(pairs: DataFrame, by: str) -> DataFrame:
    """rows and passthrough_rate (share of source = target) by file."""
    return pairs.groupBy(by).agg(F.count("*").alias("rows"), F.avg((F.col("source") == F.col("target")).cast("double")).alias("passthrough_rate"))


def passthrough_total(pairs: DataFrame) -> DataFrame:
    """One row; the rate of no rows is NaN."""
    rate = F.avg((F.col("source") == F.col("target")).cast("double"))
    return pairs.agg(F.count("*").alias("rows"), F.coalesce(rate, F.lit(float("nan"))).alias("passthrough_rate"))


def seeded_order(key: Column, seed: int) -> Column:
    """What a seeded shuffle sorts by: the same however rows are partitioned."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split(rows: DataFrame, key: str, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """rows with split: the first max(1, int(total * ratio)) of the shuffled order are `valid`, the others `train`.

    The place in the shuffled order isn't computed for all rows: the boundary is found by the leading hex digits' counts,
    then only rows of the boundary's bucket are ranked.
    """
    if not 0 <= ratio <= 1:
        raise DataContractError("0 <= ratio <= 1")
    h = seeded_order(F.col(key), seed)
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), h.alias("h"), F.col(key).alias("k"), F.substring(h, 1, 4).alias("bucket"))
    counts = keyed.groupBy("bucket").count()  # 65536 rows at most
    before = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"), F.col("count"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("total"))
    sized = before.withColumn("n_valid", F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(ratio)).cast("long")))
    placed = keyed.join(F.broadcast(sized), "bucket")
    inside = (F.col("before") < F.col("n_valid")) & (F.col("before") + F.col("count") > F.col("n_valid"))
    edge = placed.where(inside).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", "k")))
    whole = placed.where(~inside).withColumn("place", F.when(F.col("before") < F.col("n_valid"), F.lit(0).cast("long")).otherwise(F.col("total") + 1))
    both = edge.select("row", "place", "n_valid").union(whole.select("row", "place", "n_valid"))
    return both.select("row.*", F.when(F.col("place") <= F.col("n_valid"), "valid").otherwise("train").alias("split"))


def shard(rows: DataFrame, index: str, n: int, k: int) -> DataFrame:
    """Rows whose index modulo n is k."""
    if n < 1 or not 0 <= k < n:
        raise DataContractError("n >= 1 and 0 <= k < n")
    return rows if n == 1 else rows.where(F.col(index) % n == k)


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def merged(shards: list[DataFrame], sort_key: str | None = "id", position: str = "index") -> DataFrame:
    """All rows of the shards in order of the key, then shard, then place; a null key is an error. Absent columns are null."""
    numbered = [s.withColumn("file_no", F.lit(i)) for i, s in enumerate(shards)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    if sort_key and not rows.where(F.col(sort_key).isNull()).isEmpty():
        raise DataContractError(f"rows without {sort_key} can't be sorted")
    return rows.orderBy(*[c for c in (sort_key, "file_no", position) if c])


def merged_metadata(root: dict, n: int) -> dict:
    """The first shard's root; its `simplification`, if there is one, tells that n shards were merged."""
    if "simplification" not in root:
        return dict(root)
    return root | {"simplification": {**(root["simplification"] or {}), "sharding": {"num_shards": n, "merged": True}}}


def stage_metadata(root: dict, stage: str, values: dict) -> dict:
    return root | {stage: values}


def with_source_copy(rows: DataFrame, field: str = "source_caption", caption: str = "caption", ann: str = "ann") -> DataFrame:
    """ann (VARIANT) with field set to the caption where the key is absent; a null that is there stays. No field: unchanged."""
    if not field:
        return rows
    as_map = F.expr(f"cast({ann} AS map<string, variant>)")
    value = F.expr(f"variant_get({ann}, '$.{caption}')")
    filled = F.map_concat(as_map, F.create_map(F.lit(field), F.coalesce(value, F.expr("parse_json('null')"))))
    return rows.withColumn(ann, F.when(F.expr(f"variant_get({ann}, '$.{field}') IS NULL"), F.to_variant_object(filled)).otherwise(F.col(ann)))


def caption_text(ann: str = "ann", field: str = "caption") -> Column:
    """The field as text: a null that is there reads `None`, numbers and flags as they are written."""
    value = F.expr(f"variant_get({ann}, '$.{field}')")
    return F.when(F.is_variant_null(value), "None").otherwise(F.expr(f"variant_get({ann}, '$.{field}', 'string')"))
