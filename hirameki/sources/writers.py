"""Writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["REVIEW_KEYS", "export_document", "reviewed_root", "text_file", "write_json_lines", "write_pairs_csv", "write_summary"]

#: Keys of the root that a saved review keeps beside its annotations, null where there is none.
REVIEW_KEYS = ["info", "images", "licenses", "simplification"]


#: Characters that text_file() sends to the store at once.
PIECE = 1 << 20


@contextmanager
def text_file(spark: SparkSession, path: str) -> Iterator[Callable[[str], None]]:
    """Gives a function that appends text to a new file in any store that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        files = files.getRaw()  # no checksum beside a file that people may edit
    out, kept, size = files.create(at, True), [], 0

    def flush() -> None:
        nonlocal size
        out.write(bytearray("".join(kept).encode()))
        kept.clear()
        size = 0

    def write(text: str) -> None:
        nonlocal size
        kept.append(text)
        size += len(text)
        if size >= PIECE:
            flush()

    try:
        yield write
        flush()
    finally:
        out.close()


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Nulls are written."""
    rows.write.option("ignoreNullFields", False).json(path)


def write_pairs_csv(rows: DataFrame, path: str, source_name: str = "source", target_name: str = "target") -> None:
    """Outer white space of texts stays."""
    named = rows.select(F.col("source").alias(source_name), F.col("target").alias(target_name)).write.option("header", True).option("quote", '"').option("escape", '"')
    named.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_summary(one: DataFrame, path: str) -> dict[str, Any]:
    """The one row of an aggregate as pretty JSON, in one file."""
    row = one.first()
    values = row.asDict(recursive=True) if row else {}
    with text_file(one.sparkSession, path) as write:
        write(json.dumps(values, ensure_ascii=False, indent=2))
    return values


def reviewed_root(root: dict[str, Any]) -> dict[str, Any]:
    """What a review keeps of a root."""
    return {k: root.get(k) for k in REVIEW_KEYS}


def written_value(x: Any) -> Any:
    """Numbers with a fraction are decimals in a VARIANT; a VARIANT inside a struct is written as what it holds."""
    if isinstance(x, Decimal):
        return float(x)
    if hasattr(x, "toPython"):
        return x.toPython()
    raise TypeError(f"{type(x).__name__} is no JSON value")


def export_document(rows: DataFrame, root: dict[str, Any], path: str, order: str = "index", indent: int | None = None) -> int:
    """One JSON document: root, and rows (a column ann: VARIANT or struct) as `annotations`, in order.

    Rows stream through the driver a partition at a time; keep large results as Parquet or JSON lines. Returns their number.
    """
    n = 0
    with text_file(rows.sparkSession, path) as write:
        head = json.dumps(root, ensure_ascii=False, indent=indent, default=written_value)
        write(head[:-1].rstrip() + (", " if root else "") + '"annotations": [')
        for row in rows.orderBy(order).select("ann").toLocalIterator():
            value = row["ann"]
            value = value.toPython() if hasattr(value, "toPython") else value.asDict(recursive=True)
            write((", " if n else "") + json.dumps(value, ensure_ascii=False, default=written_value))
            n += 1
        write("]}")
    return n
