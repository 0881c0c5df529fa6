"""The queries opN_<name> that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirameki.cluster import ship

from . import bytebpe, embeddings, langid, linededup, near, packing, quality, substrings, tokencount, tokenfiles
from .common import shared_dir, tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.find_duplicate_lines(docs).select("doc_id", "n_lines", "n_removed", "removed")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bytebpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bytebpe.decode(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read(spark, to).mapInArrow(tidied(tokenfiles.crc32), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's first line stands for the prompt of an example: its tokens bear no loss
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), prompt="\n")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embeddings.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_near_duplicates, op3_token_counts, op4_byte_bpe, op5_token_files, op6_quality_rules, op7_language_id, op8_packing, op9_substring_dedup, op10_embedding_dedup)}
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"
REACH = """both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x)"""

ORACLES: dict[str, str] = {
    "op2_near_duplicates": f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
    shingles AS (SELECT id, g, count(*) AS c FROM (SELECT id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM nodes)) GROUP BY id, g),
    total AS (SELECT id, sum(c) AS n FROM shingles GROUP BY id),
    shared AS (SELECT a.id AS x, b.id AS y, sum(least(a.c, b.c)) AS s FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
    links AS (SELECT x, y FROM shared JOIN total p ON p.id = x JOIN total q ON q.id = y WHERE s >= 0.8 * (p.n + q.n - s)), {REACH}
    SELECT a AS doc_id, min(b) AS class_id, min(b) = a AS kept FROM reach GROUP BY a""",
    "op6_quality_rules": quality.oracle(),
    "op9_substring_dedup": f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
    gone AS (SELECT doc_id, i + j AS p, true AS hit FROM again, range(20) AS s(j) GROUP BY doc_id, p),
    each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN
      (SELECT doc_id, count(hit) AS n, string_agg(word, ' ' ORDER BY p) FILTER (hit IS NULL) AS kept FROM each LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id) USING (doc_id)""",
    "op10_embedding_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    links AS (SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.id < b.id AND list_dot_product(a.v, b.v) >= 0.9 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), {REACH}
    SELECT a AS vec_id, (SELECT count(*) FROM both_ways WHERE x = a) AS n_links, min(b) AS component_id, min(b) = a AS kept FROM reach GROUP BY a""",
}
