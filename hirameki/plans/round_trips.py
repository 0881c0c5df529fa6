"""Sources and sinks as queries: whole tables are written by a sink to the shared folder and read back by a source.

What is returned comes from the files alone, and the SQL computes it from the tables. The stand-ins are the catalog's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirameki import sources
from hirameki.cluster import workspace
from hirameki.operators import coverage, dataset, review, training
from hirameki.plans.catalog import PAIRS, RUNS, TILED, VOCABULARY, pairs, query, table

MISSING = ", ".join(f"'{m}'" for m in sources.MISSING)


def as_document(rows: DataFrame, order: str, root: dict, path: str, *fields: str) -> str:
    """Writes rows as an annotation document with these fields, and gives its path."""
    sources.export_document(rows.select(order, F.struct(*fields).alias("ann")), root, path, order)
    return path


def got(field: str, kind: str):
    return F.expr(f"variant_get(ann, '$.{field}', '{kind}')").alias(field)


@query("SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN text END AS even_text FROM conversations")
def json_lines_round_trip(spark, sf_dir):
    path = workspace(spark)
    sources.write_json_lines(table(spark, sf_dir, "conversations").withColumn("even_text", F.when(F.col("turn") % 2 == 0, F.col("text"))), path)
    return sources.json_lines(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, even_text STRING")


@query(f"""WITH {PAIRS} SELECT CAST(conv_id % 3 AS INTEGER) AS file, ' ' || source || chr(10) AS source, target, count(*) AS rows FROM pairs
    WHERE target NOT IN ({MISSING}) GROUP BY ALL""")
def csv_round_trip(spark, sf_dir):
    """Three files of a corpus, united; texts begin and end with white space."""
    path = workspace(spark)
    rows = pairs(spark, sf_dir).withColumn("source", F.concat(F.lit(" "), "source", F.lit("\n")))
    read = []
    for k in range(3):
        sources.write_pairs_csv(rows.where(F.col("conv_id") % 3 == k), f"{path}/{k}", "from", "to")
        read.append(sources.pairs_csv(spark, f"{path}/{k}", "from", "to").withColumn("file", F.lit(k)))
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("file", "source", "target").agg(F.count("*").alias("rows"))


@query("SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS INTEGER) AS index, conv_id AS id, text AS caption, 'made' AS info FROM conversations")
def document_round_trip(spark, sf_dir):
    """Rows and the other keys of the root; all rows have to have a caption."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("place"), F.col("conv_id").alias("id"), F.col("text").alias("caption"))
    path = as_document(rows, "place", dataset.stage_metadata({"info": "made"}, "sampling_filtering", {"n": 1.5}), f"{workspace(spark)}/all.json", "id", "caption")
    info = sources.root_metadata(spark, path).where("key = 'info'").select(F.expr("cast(value AS string)").alias("info"))  # one row
    found = sources.require_field(sources.annotations(spark, path), "id", "caption")
    return found.select("index", got("id", "bigint"), got("caption", "string")).crossJoin(F.broadcast(info))


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INTEGER) AS file_no, CAST(row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS INTEGER) AS index FROM orders""")
def shard_files_round_trip(spark, sf_dir):
    path, rows = workspace(spark), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    for k in range(4):
        as_document(dataset.shard(rows, "id", 4, k), "id", {}, f"{path}/shard{k}.json", "id")
    return sources.shards(spark, f"{path}/shard*.json").select(got("id", "bigint"), "file_no", "index")


@query("SELECT DISTINCT w AS token FROM (SELECT unnest(string_split_regex(text, '[ \t-\r]+')) AS w FROM documents) WHERE w <> ''")
def vocabulary_lines(spark, sf_dir):
    path = workspace(spark)
    table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \t-\r]+")).alias("value")).write.text(path)
    return sources.vocabulary(spark, path)


@query("""SELECT conv_id AS index, turn AS place, text, CASE WHEN role = 'system' THEN NULL ELSE -CAST(length(text) AS DOUBLE) / 8 END AS score FROM conversations""")
def sample_lines(spark, sf_dir):
    """A conversation's turns are candidates of one record; places are those of the list, turns come in order."""
    path = workspace(spark)
    turns = table(spark, sf_dir, "conversations").withColumn("score", F.when(F.col("role") != "system", -F.length("text").cast("double") / 8))
    records = turns.groupBy(F.col("conv_id").alias("index")).agg(F.sort_array(F.collect_list(F.struct("turn", "text", "score"))).alias("t"))
    sources.write_json_lines(records.select("index", F.transform("t", lambda c: F.struct(c["text"].alias("text"), c["score"].alias("score"))).alias("candidates")), path)
    found = sources.samples(spark, path).select("index", F.posexplode("candidates").alias("place", "c"))
    return found.select("index", F.col("place").cast("long").alias("place"), "c.text", "c.score")


@query(f"WITH RECURSIVE {RUNS} SELECT p_partkey AS id, p_name AS caption, CAST(len(runs) AS BIGINT) AS n_missing, array_to_string(runs, '|') AS missing FROM part JOIN runs ON replace(p_name, ' ', '') = t WHERE NOT {TILED}")
def failure_lines(spark, sf_dir):
    path = workspace(spark)
    failed = coverage.sides(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY))[1]
    sources.write_json_lines(failed.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("caption"), coverage.missing_tokens(F.col("p_name"), VOCABULARY).alias("missing_tokens")), path)
    return sources.failures(spark, path).select("id", "caption", F.size("missing_tokens").cast("long").alias("n_missing"), F.array_join("missing_tokens", "|").alias("missing"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS index, p_partkey AS id, p_name AS caption FROM part WHERE NOT {TILED}")
def failed_document(spark, sf_dir):
    failed = coverage.sides(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY))[1]
    path = as_document(failed.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("caption")), "id", {"info": 1}, f"{workspace(spark)}/failed.json", "id", "caption")
    return sources.annotations(spark, path).select("index", got("id", "bigint"), got("caption", "string"))


@query(f"SELECT count(*) AS total, count_if({TILED}) AS passed, count(*) - count_if({TILED}) AS failed, round(count_if({TILED}) / count(*), 9) AS pass_rate FROM part")
def summary_document(spark, sf_dir):
    path = f"{workspace(spark)}/summary.json"
    sources.write_summary(coverage.pass_rate(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY)), path)
    found = spark.read.option("multiLine", True).schema("total BIGINT, passed BIGINT, failed BIGINT, pass_rate DOUBLE").json(path)
    return found.withColumn("pass_rate", F.round("pass_rate", 9))


@query("SELECT n_name AS token, r_name AS replacement FROM nation JOIN region ON n_regionkey = r_regionkey")
def replacement_map(spark, sf_dir):
    path, regions = workspace(spark), table(spark, sf_dir, "region")
    both = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    both.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name")))).alias("value")).write.text(path)  # nations are few
    return sources.replacements(spark, path, regions.select(F.col("r_name").alias("token")))


@query(f"WITH RECURSIVE {RUNS} SELECT DISTINCT unnest(runs) AS token FROM part JOIN runs ON replace(p_name, ' ', '') = t WHERE NOT {TILED}")
def outside_list(spark, sf_dir):
    """The list of missing tokens that one stage writes and another reads."""
    path = workspace(spark)
    failed = coverage.sides(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY))[1]
    counts = coverage.frequencies(failed, coverage.missing_tokens(F.col("p_name"), VOCABULARY))
    counts.agg(F.to_json(F.collect_list(F.struct("token", "count"))).alias("value")).write.text(path)  # one JSON list, of distinct tokens
    return sources.outside_tokens(spark, path)


@query("SELECT text, count(*) AS rows FROM (SELECT 'given first' AS text UNION ALL SELECT DISTINCT p_name FROM part) GROUP BY text")
def input_texts(spark, sf_dir):
    path = workspace(spark)
    table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit("\t\n")).alias("value")).distinct().write.text(path)
    return sources.inline_texts(spark, ["given first"], path).groupBy("text").agg(F.count("*").alias("rows"))


@query("""SELECT o_orderkey::VARCHAR AS source, o_orderpriority AS target,
    CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'valid' ELSE 'train' END AS split FROM orders""")
def train_valid_files(spark, sf_dir):
    path = workspace(spark)
    both = dataset.split(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("target")), "o_orderkey")
    both.select(F.col("o_orderkey").cast("string").alias("source"), "target", "split").write.partitionBy("split").json(path)
    train, valid = sources.train_valid(spark, f"{path}/split=train", f"{path}/split=valid")
    return train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))


@query("""SELECT doc_id AS id, source AS caption, CASE WHEN doc_id % 7 = 0 THEN 'new ' || doc_id ELSE lang END AS caption_replaced, CAST(n_chars AS DOUBLE) / 4 AS lm_ppl, 'n' || doc_id AS note FROM documents""")
def review_save(spark, sf_dir):
    """A base document with merged scores and edits, saved and read back; fields that a review doesn't know stay."""
    path = workspace(spark)
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("caption"), F.col("lang").alias("caption_replaced"), F.concat(F.lit("n"), "doc_id").alias("note"))
    base = review.opened(sources.annotations(spark, as_document(rows, "id", {"info": 1}, f"{path}/base.json", "id", "caption", "caption_replaced", "note")))
    scores = docs.select(F.col("doc_id").alias("id"), (F.col("n_chars").cast("double") / 4).alias("lm_ppl"), F.lit(0).alias("place"))
    edits = docs.where("doc_id % 7 = 0").select(F.lit(0).cast("long").alias("seq"), F.col("doc_id").alias("id"), F.concat(F.lit("new "), "doc_id").alias("caption"), F.lit(None).cast("boolean").alias("reviewed"))
    done = review.apply_edits(review.merge_scores(base, scores, "place"), edits)
    sources.export_document(review.saved(done), sources.reviewed_root({"info": 1}), f"{path}/saved.json")
    found = sources.annotations(spark, f"{path}/saved.json")
    return found.select(*[got(n, "string" if n != "id" else "bigint") for n in ("id", "caption", "caption_replaced")], got("lm_ppl", "double"), got("note", "string"))


@query("""SELECT l_orderkey, array_to_string(list_transform(list(CASE WHEN l_linenumber % 2 = 0 THEN -100 ELSE l_quantity::BIGINT END ORDER BY l_linenumber, l_quantity), lambda x: CASE WHEN x = -100 THEN 1 ELSE x END), ' ') AS labels
    FROM lineitem GROUP BY l_orderkey""")
def unmasked_labels(spark, sf_dir):
    masked = F.when(F.col("l_linenumber") % 2 == 0, F.lit(training.MASKED)).otherwise(F.col("l_quantity")).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", masked.alias("x")))).alias("l"))
    return rows.select("l_orderkey", F.array_join(training.unmasked(F.col("l.x"), 1), " ").alias("labels"))
