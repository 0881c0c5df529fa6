"""The review view: merged scores, filters, order, pages and edits over a base table and an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType

#: Fields that a merged file only fills where the base lacks them, and those that it never touches.
BASE_FIELDS, KEYS = ("id", "image_id", "caption", "source_caption", "caption_replaced", "reviewed"), ("id", "image_id")

#: What the known fields of an annotation are read as.
KNOWN = {"id": "bigint", "image_id": "bigint", "caption": "string", "source_caption": "string", "caption_replaced": "string", "reviewed": "boolean", "missing_tokens": "array<string>"}


def field_of(ann: Column, name: str, kind: str) -> Column:
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(ann, f"$[{quote}{name}{quote}]", kind)


def opened(rows: DataFrame, whole: bool = True) -> DataFrame:
    """index, ann (VARIANT), and a column for each field that any row has: known ones by their type, others as numbers if all are, else as text.

    Known fields that no row has are null, or left out (not whole).
    """
    numeric = F.bool_and(F.expr("schema_of_variant(value) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)'"))
    found = rows.select(F.explode(F.expr("try_cast(ann AS map<string, variant>)"))).groupBy("key").agg(numeric.alias("n")).collect()  # names of fields
    others = {r["key"]: "double" if r["n"] else "string" for r in found if r["key"] not in (*KNOWN, "index", "ann", "_edited")}
    kinds = {k: v for k, v in KNOWN.items() if whole or k in {r["key"] for r in found}} | dict(sorted(others.items()))
    return rows.select("index", "ann", *[field_of(F.col("ann"), k, v).alias(k) for k, v in kinds.items()])


def as_variant(value: Column, kind: DataType) -> Column:
    return F.coalesce(F.to_variant_object(value) if isinstance(kind, StructType | MapType) else value.cast("variant"), F.parse_json(F.lit("null")))


def saved(rows: DataFrame) -> DataFrame:
    """index, and ann with the columns that have another value than it holds; all else in ann stays as it is, an absent key absent."""
    entries = []
    for f in rows.schema.fields:
        if f.name not in ("index", "ann", "_edited"):
            value, old = F.col(f"`{f.name}`"), field_of(F.col("ann"), f.name, f.dataType.simpleString())
            entries.append(F.when(~value.eqNullSafe(old), F.struct(F.lit(f.name).alias("key"), as_variant(value, f.dataType).alias("value"))))
    new = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    changed = rows.select("index", "ann", new.alias("new"))
    kept = F.map_filter(F.expr("cast(ann AS map<string, variant>)"), lambda k, _: ~F.array_contains(F.map_keys("new"), k))
    return changed.select("index", F.when(F.size("new") > 0, F.to_variant_object(F.map_concat(kept, "new"))).otherwise(F.col("ann")).alias("ann"))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key its last row."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def merge_scores(base: DataFrame, scores: DataFrame, order: str, key: str = "id") -> DataFrame:
    """base with the fields of scores, by id: base fields only where base has none, others overwritten, also by null.

    order: the place of a row in scores; of repeated ids the last counts. Ids that base lacks are ignored. In base,
    of repeated ids the last row (by index) receives. Call once per file, later files later. Where scores has ann (see
    opened), a row gives only the fields that its ann has.
    """
    fields = [c for c in scores.columns if c not in (*KEYS, key, order, "ann", "index")]
    has = F.map_keys(F.expr("cast(ann AS map<string, variant>)")) if "ann" in scores.columns else F.array(*[F.lit(c) for c in fields]).cast("array<string>")
    theirs = last_of(scores, key, order).select(key, has.alias("_has"), *[F.col(f"`{c}`").alias(f"_new_{c}") for c in fields])
    receives = F.row_number().over(Window.partitionBy(key).orderBy(F.col("index").desc())) == 1
    joined = base.withColumn("_receives", receives).join(theirs, key, "left")

    def met(c: str) -> Column:
        return F.coalesce(F.array_contains("_has", c) & F.col("_receives"), F.lit(False))

    kept = []
    for c in base.columns:
        if c in fields:
            new = F.col(f"_new_{c}")
            kept.append((F.when(met(c) & F.col(f"`{c}`").isNull(), new) if c in BASE_FIELDS else F.when(met(c), new)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            kept.append(F.col(f"`{c}`"))
    return joined.select(*kept, *[F.when(met(c), F.col(f"_new_{c}")).alias(c) for c in fields if c not in base.columns])


def attach_missing(base: DataFrame, failures: DataFrame, order: str, key: str = "id") -> DataFrame:
    """base with missing_tokens of the last failure of its id that has some."""
    some = failures.where(F.size("missing_tokens") > 0)
    mine = last_of(some, key, order).select(key, F.col("missing_tokens").alias("_missing"))
    own = F.col("missing_tokens") if "missing_tokens" in base.columns else F.lit(None).cast("array<string>")
    return base.join(mine, key, "left").withColumn("missing_tokens", F.coalesce("_missing", own)).drop("_missing")


def apply_edits(base: DataFrame, edits: DataFrame, key: str = "id", field: str = "caption_replaced") -> DataFrame:
    """base with the last caption (as field) and the last reviewed flag of each id in the log (seq, id, caption, reviewed), and _edited.

    A row of the log has one of the two (the other null); only captions mark a row as edited. Unknown ids are ignored.
    """
    texts = last_of(edits.where("caption IS NOT NULL"), key, "seq").select(key, F.col("caption").alias("_caption"))
    flags = last_of(edits.where("reviewed IS NOT NULL"), key, "seq").select(key, F.col("reviewed").alias("_reviewed"))
    joined = base.drop("_edited").join(texts, key, "left").join(flags, key, "left")
    return (
        joined.withColumn(field, F.coalesce("_caption", F.col(field))).withColumn("reviewed", F.coalesce("_reviewed", F.col("reviewed").cast("boolean")))
        .withColumn("_edited", F.col("_caption").isNotNull()).drop("_caption", "_reviewed")
    )


def filtered(rows: DataFrame, missing_only: bool = False, edited_only: bool = False, unreviewed_only: bool = False) -> DataFrame:
    if missing_only:
        rows = rows.where(F.coalesce(F.size("missing_tokens"), F.lit(0)) > 0)
    if edited_only:
        rows = rows.where("_edited")
    if unreviewed_only:
        rows = rows.where(~F.coalesce(F.col("reviewed"), F.lit(False)))
    return rows


def ordered(rows: DataFrame, field: str = "id", descending: bool = False, position: str = "index") -> DataFrame:
    """Ascending with nulls last, descending with nulls first (an absent id counts as 0); ties keep their place in both."""
    value = F.coalesce(F.col(field), F.lit(0)) if field == "id" else F.col(f"`{field}`")
    return rows.orderBy(value.desc_nulls_first() if descending else value.asc_nulls_last(), F.col(position).asc())


def page(rows: DataFrame, offset: int, limit: int, field: str = "id", descending: bool = False, position: str = "index") -> DataFrame:
    """A slice of the order."""
    return ordered(rows, field, descending, position).offset(max(0, offset)).limit(max(0, limit))


def payload(rows: DataFrame) -> DataFrame:
    """What a page shows: missing_tokens as a list, reviewed as a flag."""
    return rows.withColumn("missing_tokens", F.coalesce("missing_tokens", F.array().cast("array<string>"))).withColumn("reviewed", F.coalesce(F.col("reviewed").cast("boolean"), F.lit(False)))


def extra_fields(rows: DataFrame, ann: str = "ann") -> DataFrame:
    """name of all keys that any open row (VARIANT) has, without the base fields; sorted."""
    rows.createOrReplaceTempView("_open_rows")
    keys = rows.sparkSession.sql(f"SELECT DISTINCT e.key AS name FROM _open_rows, LATERAL variant_explode({ann}) AS e")
    return keys.where(~F.col("name").isin(*BASE_FIELDS, "missing_tokens", "_edited")).orderBy("name")


def strictest(thresholds: dict[str, float] | None) -> float | None:
    """The largest of a root's thresholds."""
    return max(thresholds.values()) if thresholds else None
