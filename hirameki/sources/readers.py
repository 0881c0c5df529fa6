"""Readers. All paths are read by Spark, so they may lie in any store that it knows."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirameki.cluster import ship
from hirameki.errors import DataContractError

__all__ = [
    "MISSING", "annotations", "checkpoint", "failures", "has_field", "inline_texts", "json_lines", "outside_tokens", "pairs_csv", "pairs_table", "pairs_xlsx",
    "records", "replacements", "require_field", "root_metadata", "samples", "shards", "train_valid", "vocabulary", "xlsx",
]

#: Fixed: cell texts that count as missing in a table of texts.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SAMPLES = "index BIGINT, id BIGINT, image_id BIGINT, source STRING, candidates ARRAY<STRUCT<text: STRING, score: DOUBLE>>"
FAILURES = "index BIGINT, id BIGINT, image_id BIGINT, caption STRING, missing_tokens ARRAY<STRING>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document's named keys; what can't be read is an error that says why."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def _reason(e: Exception) -> str:
    lines = [x.strip() for x in str(e).split("\n") if x.strip()]
    return next((x for x in lines if "MALFORMED" in x or "too large" in x.lower() or "SIZE_LIMIT" in x), lines[0] if lines else type(e).__name__)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """index (place in the list) and ann (VARIANT: an open row, in which a null and an absent key differ).

    Each annotation is a value of its own, so the limit on a VARIANT's size is one for annotations, not for documents; a
    document is read by one task, as JSON can't be split.
    """
    found = _document(spark, path, "annotations ARRAY<VARIANT>")
    try:
        lacking = found.where("annotations IS NOT NULL").isEmpty()
    except Exception as e:
        raise DataContractError(f"{path} can't be read as a document with a list `annotations`: {_reason(e)}") from e
    if lacking:
        raise DataContractError(f"{path} has no list `annotations`")
    return found.select(F.posexplode("annotations").alias("index", "ann"))


def root_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key and value (VARIANT) of the document's other keys."""
    text = spark.read.text(path, wholetext=True)
    names = [k for r in text.select(F.map_keys(F.from_json("value", "map<string,string>")).alias("k")).collect() for k in r["k"] or () if k != "annotations"]  # of one document
    if not names:
        return spark.createDataFrame([], "key string, value variant")
    quoted = [f"`{k.replace('`', '``')}`" for k in names]
    found = _document(spark, path, ", ".join(f"{q} VARIANT" for q in quoted))
    return found.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.col(q) for q in quoted]))).alias("key", "value"))


def has_field(field: str, ann: str = "ann"):
    """Whether the row has the key, be its value null."""
    return F.expr(f"variant_get({ann}, '$.{field}') IS NOT NULL")


def require_field(rows: DataFrame, *fields: str) -> DataFrame:
    """rows, if all have all the fields; one pass over the rows."""
    lacking = rows.agg(*[F.count_if(~has_field(f)).alias(f) for f in fields]).first()
    if any(lacking[f] for f in fields):
        raise DataContractError(f"rows lack {', '.join(f'`{f}` ({lacking[f]})' for f in fields if lacking[f])}")
    return rows


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per line that isn't blank; malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or one JSON array if the first character is `[`."""
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).first()
    return spark.read.schema(schema).option("multiLine", bool(first and first["v"].startswith("["))).json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Candidates by index; an index that is missing or comes twice is an error."""
    found = json_lines(spark, path, SAMPLES)
    wrong = found.groupBy("index").count().where("count > 1 OR index IS NULL")
    if not wrong.isEmpty():
        raise DataContractError(f"{path} has an index twice, or a record without one")
    return found


def failures(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, FAILURES)


def pairs_table(rows: DataFrame, source: str, target: str) -> DataFrame:
    """source and target as text, without rows that lack either."""
    lacking = [c for c in (source, target) if c not in rows.columns]
    if lacking:
        raise DataContractError(f"columns are missing: {lacking}")
    return rows.select(F.col(f"`{source}`").alias("source"), F.col(f"`{target}`").alias("target")).dropna().select(F.col("source").cast("string"), F.col("target").cast("string"))


def pairs_csv(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """All cells are text: 1.0 stays `1.0`. Cells of MISSING texts are missing."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return pairs_table(rows.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in rows.columns]), source, target)


def xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """The named sheet, or the first if there is none of that name; the first row names the columns, all cells are text.
    Several files have to have the same header.

    Files are read whole, one task each: a spreadsheet holds a million rows at most.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([next(iter(_sheet(c, sheet)), []) for c in batch.column("content").to_pylist()], pa.list_(pa.string()))], ["names"])

    found = files.mapInArrow(headers, "names array<string>").distinct().limit(2).collect()  # only column names leave the workers
    if len(found) != 1:
        raise DataContractError(f"{path} has spreadsheets of different headers" if found else f"{path} has no spreadsheet")
    names = found[0]["names"]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                cells = [[*r[: len(names)], *[None] * (len(names) - len(r))] for r in list(_sheet(content, sheet))[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in cells], pa.string()) for i in range(len(names))], names)

    from pyspark.sql.types import StringType, StructField, StructType

    return files.mapInArrow(rows, StructType([StructField(n, StringType()) for n in names]))


def _sheet(content: bytes, name: str):
    """Rows of cell texts."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = {s.get("name"): s.get(rel) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets.get(name) or next(iter(sheets.values()))]
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{main}row"):
            out: list[str | None] = []
            for c in row.iter(f"{main}c"):
                column = 0
                for letter in re.match(r"[A-Z]+", c.get("r", ""))[0] if c.get("r") else "":
                    column = column * 26 + ord(letter) - 64
                value = c.find(f"{main}v")
                text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{main}t")) or None
                text = shared[int(text)] if c.get("t") == "s" and text is not None else text
                out += [None] * ((column or len(out) + 1) - 1 - len(out)) + [None if text in MISSING else text]
            yield out


def pairs_xlsx(spark: SparkSession, path: str, source: str, target: str, sheet: str = "平易化コーパス") -> DataFrame:
    return pairs_table(xlsx(spark, path, sheet), source, target)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token: distinct lines that aren't empty; no line is an error."""
    found = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("token")).where("token <> ''").distinct()
    if found.isEmpty():
        raise DataContractError(f"{path} has no token")
    return found


def replacements(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """token and replacement of a JSON object; each replacement has to be a token."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    found = text.select(F.explode("m").alias("token", "replacement"))
    unknown = found.join(tokens.select(F.col("token").alias("replacement")), "replacement", "left_anti").limit(5).collect()
    if unknown:
        raise DataContractError(f"replacements that aren't tokens: {[r['replacement'] for r in unknown]}")
    return found


def outside_tokens(spark: SparkSession, path: str | None) -> DataFrame | None:
    """token: of a JSON list of texts or of objects with `token`; None without a path."""
    if not path:
        return None
    raw = spark.read.text(path, wholetext=True)
    objects = raw.select(F.explode(F.from_json("value", "array<struct<token:string>>")).alias("t")).select("t.token")
    texts = raw.select(F.explode(F.from_json("value", "array<string>")).alias("token"))
    if raw.where(F.ltrim("value").startswith("[")).isEmpty():
        raise DataContractError(f"{path} is no JSON list")
    return objects.union(texts.where("NOT startswith(token, '{')")).where("token IS NOT NULL").distinct()


def inline_texts(spark: SparkSession, texts: list[str] | None = None, path: str | None = None) -> DataFrame:
    """index and text: the texts given first, then the stripped lines of the file that aren't empty; none is an error."""
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts or [])], "index long, text string")
    if path:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line")).select((F.col("i") + len(texts or [])).alias("index"), F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("text"))
        given = given.union(lines.where("text <> ''"))
    if given.isEmpty():
        raise DataContractError("no text is given")
    return given


def shards(spark: SparkSession, pattern: str) -> DataFrame:
    """index, ann and file_no of all documents that the pattern names, in order of their paths; none is an error."""
    from functools import reduce

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = sorted(f.getPath().toString() for f in found)
    if not paths:
        raise DataContractError(f"{pattern} names no file")
    return reduce(DataFrame.unionByName, [annotations(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)])


def train_valid(spark: SparkSession, train: str, valid: str) -> tuple[DataFrame, DataFrame]:
    return tuple(json_lines(spark, p, "source STRING, target STRING") for p in (train, valid))


def checkpoint(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The folder and the checkpoint to resume from: itself if it has a state, else the one of the largest number, else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise DataContractError(f"{path} is no folder")
    names = {f.getPath().getName(): f.isDirectory() for f in fs.listStatus(at)}
    if "trainer_state.json" in names:
        return path, path
    numbered = [(int(m[1]), n) for n, folder in names.items() if folder and (m := re.fullmatch(r"checkpoint-(\d+)", n))]
    return path, f"{path}/{max(numbered)[1]}" if numbered else None
