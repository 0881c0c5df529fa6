"""Each operator as a query over whole tables, beside SQL for DuckDB.

Stand-ins: captions are part names and turns of conversations; pairs are a turn and the next one; candidates are the
turns of a conversation, scored by minus their length (null for the system's); scores and losses are events; the
review view is documents with labels. Doubles are rounded to the same places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirameki import providers
from hirameki.cluster import ship
from hirameki.functions import metrics, scores
from hirameki.functions import morphology as M
from hirameki.functions import text as T
from hirameki.functions.vocabulary import Vocabulary, covered, segments, uncovered_runs
from hirameki.operators import coverage, dataset, review, selection, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(values: list[str]) -> str:
    return ", ".join(f"('{v}')" for v in values)


#: A closed vocabulary for part names: whole words, parts of words, and none for some letters.
TOKENS = "small sma ll red re d wid get widget blue bl ue bolt olt hot ho gear ge ar gizmo izm ring in g ri large arg plate late la p rod o".split()
VOCABULARY = Vocabulary(TOKENS)
#: DuckDB's class of all Unicode white space.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TILED = f"regexp_full_match(replace(p_name, ' ', ''), '(?:{'|'.join(TOKENS)})*')"
PAIRS = """pairs AS (SELECT conv_id, turn, role, text AS source, lead(text) OVER w AS target, coalesce(lead(text, 2) OVER w, text) AS prediction
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, source, target (the next turn, null after the last), prediction (the one after, or the source)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("text", "source")
    return turns.withColumn("target", F.lead("source").over(w)).withColumn("prediction", F.coalesce(F.lead("source", 2).over(w), "source"))


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where("target IS NOT NULL")


# Pairs, split, shards


@query(f"WITH {PAIRS} SELECT role, count(*) AS rows, avg(CASE WHEN source = target THEN 1.0 ELSE 0.0 END) AS passthrough_rate FROM pairs WHERE target IS NOT NULL GROUP BY role")
def passthrough_rate_by_source(spark, sf_dir):
    return dataset.passthrough_rates(complete(spark, sf_dir), "role")


@query(f"WITH {PAIRS} SELECT count(*) AS rows, avg(CASE WHEN source = target THEN 1.0 ELSE 0.0 END) AS passthrough_rate FROM pairs WHERE target IS NOT NULL")
def passthrough_rate_total(spark, sf_dir):
    return dataset.passthrough_total(complete(spark, sf_dir))


SPLIT = """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'valid' ELSE 'train' END AS split FROM orders"""


@query(SPLIT)
def seeded_split_rows(spark, sf_dir):
    return dataset.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT split, count(*) AS rows FROM ({SPLIT}) GROUP BY split")
def seeded_split_counts(spark, sf_dir):
    return dataset.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("split").agg(F.count("*").alias("rows"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 = 3")
def shard_filter(spark, sf_dir):
    return dataset.shard(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 4, 3)


@query("SELECT o_orderkey AS id, o_custkey AS image_id, row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) AS place FROM orders")
def shard_merge_sorted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("key"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"))
    merged = dataset.merged([dataset.shard(rows, "id", 4, k).withColumn("index", F.col("id")) for k in range(4)], sort_key="id")
    # the place in the whole order: counts of the runs before (of one key and some ids in a row), and the rank in the run
    merged = merged.withColumn("run", F.floor(F.col("id") / 10_000))
    before = merged.groupBy("key", "run").count().select("key", "run", (F.sum("count").over(Window.orderBy("key", "run")) - F.col("count")).alias("before"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("key", "run").orderBy("id")))
    return ranked.join(before, ["key", "run"]).select("id", "image_id", (F.col("before") + F.col("rank")).alias("place"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 100")
def head_rows(spark, sf_dir):
    return dataset.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 100)


# Text


@query(f"SELECT doc_id, length(t) AS n, md5(t) AS hash FROM (SELECT doc_id, regexp_replace(text, '{SPACE}', '', 'g') AS t FROM documents)")
def whitespace_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.without_white_space(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("hash"))


#: Texts with kana, kanji and gloss made from part names and keys, as the tables hold none.
KANA_FROM, KANA_TO = "aeioubcdfg", "アェヴヵヶーガパン日"


@query(f"SELECT p_partkey, t, translate(t, '{T.KATAKANA}', '{T.HIRAGANA}') AS kana FROM (SELECT p_partkey, translate(p_name, '{KANA_FROM}', '{KANA_TO}') AS t FROM part)")
def kata_to_hira(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", KANA_FROM, KANA_TO).alias("t"))
    return rows.select("p_partkey", "t", T.to_hiragana(F.col("t")).alias("kana"))


@query("SELECT p_partkey, t, CASE WHEN instr(t, '-') > 1 AND instr(t, '-') < length(t) THEN split_part(t, '-', 1) ELSE t END AS head FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN '-' || p_name ELSE replace(p_name, ' ', '') || '-' END AS t FROM part)")
def strip_gloss(spark, sf_dir):
    name, turn = F.col("p_name"), F.col("p_partkey") % 3
    made = F.when(turn == 0, F.replace(name, F.lit(" "), F.lit("-"))).when(turn == 1, F.concat(F.lit("-"), name)).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("")), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("t")).select("p_partkey", "t", T.without_gloss(F.col("t")).alias("head"))


LATIN = ["abc", "ABC", "ＡＢｃ", "", "a1", "犬", "a b", "n_name"]


@query(f"SELECT t, regexp_full_match(t, '[A-Za-zＡ-Ｚａ-ｚ]+') AS latin FROM (SELECT * FROM (VALUES {listed(LATIN)}) AS v(t) UNION ALL SELECT p_name FROM part UNION ALL SELECT r_name FROM region)")
def latin_token(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in LATIN], "t string").union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "region").select("r_name"))
    return rows.select("t", T.is_latin(F.col("t")).alias("latin"))


#: What the digits of order keys stand for, so that keys become numbers in kanji, some of them none.
KANJI = "十一二百三四千万億犬"


@query(f"""WITH RECURSIVE made AS (SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', '{KANJI}') AS t FROM orders),
    walk AS (SELECT DISTINCT t, 0 AS k, 0::BIGINT AS total, 0::BIGINT AS section, 0::BIGINT AS number FROM made WHERE NOT contains(t, '犬')
      UNION ALL SELECT t, k + 1,
        CASE WHEN c IN ('万', '億') THEN total + (CASE WHEN section + number = 0 THEN 1 ELSE section + number END) * (CASE c WHEN '万' THEN 10000 ELSE 100000000 END) ELSE total END,
        CASE WHEN c IN ('十', '百', '千') THEN section + (CASE WHEN number = 0 THEN 1 ELSE number END) * (CASE c WHEN '十' THEN 10 WHEN '百' THEN 100 ELSE 1000 END) WHEN c IN ('万', '億') THEN 0 ELSE section END,
        CASE c WHEN '一' THEN 1 WHEN '二' THEN 2 WHEN '三' THEN 3 WHEN '四' THEN 4 ELSE 0 END
        FROM (SELECT *, substring(t, k + 1, 1) AS c FROM walk WHERE k < length(t)))
    SELECT o_orderkey, made.t, total + section + number AS n FROM made LEFT JOIN walk ON walk.t = made.t AND k = length(made.t)""")
def kanji_to_int(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.col("o_orderkey").cast("string"), "0123456789", KANJI).alias("t"))
    return rows.select("o_orderkey", "t", T.kanji_number(F.col("t")).alias("n"))


# Vocabulary


@query("SELECT w AS token, count(*) AS count FROM (SELECT unnest(string_split_regex(text, '[ \t-\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY count DESC, token LIMIT 50")
def vocab_top_tokens(spark, sf_dir):
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    return coverage.frequencies(table(spark, sf_dir, "documents"), words, top=50)


@query("""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '')) AS t FROM conversations),
    known AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \t-\r]+')) AS t FROM benchmark)
    SELECT (SELECT count(*) FROM conversations) AS total_captions, (SELECT count(*) FROM w) AS total_tokens, (SELECT count(DISTINCT t) FROM w) AS unique_tokens,
      (SELECT count(DISTINCT (conv_id, turn)) FROM w WHERE t NOT IN (SELECT t FROM known)) AS captions_with_outside_tokens,
      (SELECT count(DISTINCT (conv_id, turn)) FROM w WHERE t NOT IN (SELECT t FROM known)) / (SELECT count(*) FROM conversations) AS captions_with_outside_tokens_rate""")
def token_stats(spark, sf_dir):
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \t-\r]+")).alias("token"))
    return coverage.token_stats(table(spark, sf_dir, "conversations"), words, known)


@query(f"SELECT p_partkey, {TILED} AS ok FROM part")
def vocab_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", coverage.verdict(F.col("p_name"), VOCABULARY).alias("ok"))


@query(f"SELECT count(*) AS total, count_if({TILED}) AS passed, count(*) - count_if({TILED}) AS failed, count_if({TILED}) / count(*) AS pass_rate FROM part")
def pass_rate(spark, sf_dir):
    return coverage.pass_rate(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY))


@query(f"SELECT p_partkey, p_name FROM part WHERE {TILED}")
def split_pass_pairs(spark, sf_dir):
    return coverage.sides(table(spark, sf_dir, "part").select("p_partkey", "p_name"), coverage.verdict(F.col("p_name"), VOCABULARY))[0]


@query(f"SELECT p_partkey, p_name FROM part WHERE NOT {TILED}")
def split_fail_rows(spark, sf_dir):
    return coverage.sides(table(spark, sf_dir, "part").select("p_partkey", "p_name"), coverage.verdict(F.col("p_name"), VOCABULARY))[1]


#: One step per character over distinct names; a state per character of cost, start, whether unknown, and runs.
RUNS = f"""tokens AS (SELECT * FROM (VALUES {listed(TOKENS)}) AS v(token)),
    names AS (SELECT DISTINCT replace(p_name, ' ', '') AS t FROM part),
    walk AS (SELECT t, 0 AS k, [{{'cost': 0, 'runs': []::VARCHAR[], 'unk': false}}] AS states FROM names
      UNION ALL SELECT t, k + 1, list_append(states, (
        SELECT s FROM (
          SELECT {{'cost': states[k + 2 - length(token)].cost, 'runs': states[k + 2 - length(token)].runs, 'unk': false}} AS s, -length(token) AS r
          FROM tokens WHERE length(token) <= k + 1 AND substring(t, k + 2 - length(token), length(token)) = token
          UNION ALL SELECT {{'cost': states[k + 1].cost + 1, 'runs': CASE WHEN states[k + 1].unk
            THEN list_append(states[k + 1].runs[:-2], states[k + 1].runs[-1] || substring(t, k + 1, 1)) ELSE list_append(states[k + 1].runs, substring(t, k + 1, 1)) END, 'unk': true}}, 0)
        ORDER BY s.cost, r LIMIT 1)) FROM walk WHERE k < length(t)),
    runs AS (SELECT t, states[k + 1].runs AS runs FROM walk WHERE k = length(t))"""


@query(f"WITH RECURSIVE {RUNS} SELECT token, count(*) AS count FROM (SELECT unnest(runs) AS token FROM part JOIN runs ON replace(p_name, ' ', '') = t WHERE NOT {TILED}) GROUP BY token ORDER BY count DESC, token")
def missing_tokens_topk(spark, sf_dir):
    failed = coverage.sides(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY))[1]
    return coverage.frequencies(failed, coverage.missing_tokens(F.col("p_name"), VOCABULARY))


@query(f"""WITH RECURSIVE tokens AS (SELECT * FROM (VALUES {listed(TOKENS)}) AS v(token)),
    names AS (SELECT DISTINCT replace(p_name, ' ', '') AS t FROM part),
    walk AS (SELECT t, 0 AS k, [{{'n': 0, 'out': []::VARCHAR[]}}] AS states FROM names
      UNION ALL SELECT t, k + 1, list_append(states, (
        SELECT {{'n': states[k + 2 - length(token)].n + 1, 'out': list_append(states[k + 2 - length(token)].out, token)}} FROM tokens
        WHERE length(token) <= k + 1 AND substring(t, k + 2 - length(token), length(token)) = token AND states[k + 2 - length(token)] IS NOT NULL
        ORDER BY CASE WHEN k + 1 = length(t) THEN 0 ELSE states[k + 2 - length(token)].n END, length(token) DESC LIMIT 1)) FROM walk WHERE k < length(t))
    SELECT p_partkey, array_to_string(states[k + 1].out, '|') AS segments FROM part JOIN walk ON replace(p_name, ' ', '') = t AND k = length(t)""")
def segment_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(segments(T.without_white_space(F.col("p_name")), VOCABULARY), "|").alias("segments"))


#: The words of all documents, of up to 12 letters, as a table; texts without white space are tiled by them or not.
WORD_TABLE = "SELECT DISTINCT w AS token FROM (SELECT unnest(string_split_regex(text, '[ \t-\r]+')) AS w FROM documents) WHERE length(w) BETWEEN 1 AND 12"


@query(f"""WITH RECURSIVE tokens AS MATERIALIZED ({WORD_TABLE}), lengths AS (SELECT DISTINCT length(token) AS n FROM tokens),
    texts AS (SELECT DISTINCT regexp_replace(text, '{SPACE}', '', 'g') AS t FROM conversations),
    reach AS (SELECT t, 0 AS k FROM texts UNION SELECT t, k + n FROM reach, lengths WHERE k + n <= length(t) AND substring(t, k + 1, n) IN (SELECT token FROM tokens))
    SELECT conv_id, turn, bool_or(k = length(t)) AS ok FROM conversations JOIN reach ON t = regexp_replace(text, '{SPACE}', '', 'g') GROUP BY conv_id, turn""")
def table_vocabulary_check(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \t-\r]+")).alias("token")).where("length(token) BETWEEN 1 AND 12").distinct()
    rows, vocabulary = coverage.with_known(table(spark, sf_dir, "conversations"), F.col("text"), words)
    return rows.select("conv_id", "turn", coverage.verdict(F.col("text"), vocabulary).alias("ok"))


@query(f"WITH {PAIRS}, known AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \t-\r]+')) AS token FROM benchmark), counts AS (SELECT unnest(list_filter(string_split_regex(source, '[ \t-\r]+'), lambda x: x <> '')) AS token FROM pairs)"
       " SELECT count(DISTINCT c.token) AS unique_tokens, count(*) AS total_tokens, count(DISTINCT k.token) AS unique_listed, count(k.token) AS total_listed, count(DISTINCT c.token) - count(DISTINCT k.token) AS unique_not_listed, count(*) - count(k.token) AS total_not_listed FROM counts c LEFT JOIN known k ON c.token = k.token")
def coverage_summary(spark, sf_dir):
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \t-\r]+")).alias("token"))
    return coverage.coverage_summary(coverage.frequencies(table(spark, sf_dir, "conversations"), words), known)


WORDS = "list_filter(string_split(p_name, ' '), lambda x: x <> '')"
TILE = f"(?:{'|'.join(TOKENS)})*"


@query(f"""WITH RECURSIVE tokens AS (SELECT * FROM (VALUES {listed(TOKENS)}) AS v(token)), w AS (SELECT p_partkey, unnest({WORDS}) AS t FROM part),
    names AS (SELECT DISTINCT t FROM w WHERE t NOT IN (SELECT token FROM tokens) AND regexp_full_match(t, '{TILE}')),
    walk AS (SELECT t, 0 AS k, [{{'n': 0, 'out': []::VARCHAR[]}}] AS states FROM names
      UNION ALL SELECT t, k + 1, list_append(states, (
        SELECT {{'n': states[k + 2 - length(token)].n + 1, 'out': list_append(states[k + 2 - length(token)].out, token)}} FROM tokens
        WHERE length(token) <= k + 1 AND substring(t, k + 2 - length(token), length(token)) = token AND states[k + 2 - length(token)] IS NOT NULL
        ORDER BY CASE WHEN k + 1 = length(t) THEN 0 ELSE states[k + 2 - length(token)].n END, length(token) DESC LIMIT 1)) FROM walk WHERE k < length(t)),
    cut AS (SELECT p_partkey, unnest(coalesce(states[k + 1].out, [w.t])) AS t FROM w LEFT JOIN walk ON walk.t = w.t AND k = length(w.t)),
    o AS (SELECT DISTINCT p_partkey FROM cut WHERE t NOT IN (SELECT token FROM tokens))
    SELECT (SELECT count(*) FROM part) AS total_captions, count(*) AS total_tokens, count(DISTINCT t) AS unique_tokens, (SELECT count(*) FROM o) AS captions_with_outside_tokens,
      (SELECT count(*) FROM o) / (SELECT count(*) FROM part) AS captions_with_outside_tokens_rate FROM cut""")
def segmented_token_stats(spark, sf_dir):
    words = F.filter(F.split("p_name", " "), lambda w: w != "")
    known = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    return coverage.token_stats(table(spark, sf_dir, "part"), coverage.segmented(words, VOCABULARY), known)


@query(f"SELECT t AS token, count(*) AS count FROM (SELECT unnest({WORDS}) AS t FROM part WHERE NOT {TILED}) WHERE NOT regexp_full_match(t, '{TILE}') GROUP BY t")
def outside_tokens_of_failed(spark, sf_dir):
    failed = coverage.sides(table(spark, sf_dir, "part"), coverage.verdict(F.col("p_name"), VOCABULARY))[1]
    return coverage.frequencies(failed, coverage.outside_of_failed(F.split("p_name", " "), VOCABULARY))


# Selection and merging


@query("""SELECT conv_id, text, score FROM (SELECT conv_id, text, CASE WHEN role = 'system' THEN NULL ELSE -CAST(length(text) AS DOUBLE) END AS score, turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN NULL ELSE -CAST(length(text) AS DOUBLE) END DESC NULLS LAST, turn) AS r
    FROM conversations WHERE text IS NOT NULL AND length(text) >= 40) WHERE r = 1""")
def best_candidate(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("score", F.when(F.col("role") != "system", -F.length("text").cast("double")))
    listed_turns = F.array_sort(F.collect_list(F.struct("turn", "text", "score")))
    samples = turns.groupBy(F.col("conv_id").alias("index")).agg(F.transform(listed_turns, lambda s: F.struct(s["text"].alias("text"), s["score"].alias("score"))).alias("candidates"))
    rows = turns.select(F.col("conv_id").alias("index")).distinct()
    best = selection.with_samples(rows, samples).withColumn("best", selection.best_candidate(F.col("candidates"), lambda t: F.length(t) >= 40))
    return best.where("best IS NOT NULL").select(F.col("index").alias("conv_id"), "best.text", "best.score")


@query("""WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT c_custkey AS id, c_acctbal AS caption, value AS lm_ppl, CASE WHEN r = 1 THEN event_id END AS lm_event FROM customer LEFT JOIN e ON user_id = c_custkey AND r = 1""")
def merge_scores_by_id(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("index"), F.col("c_acctbal").alias("caption"), F.lit(None).cast("double").alias("lm_ppl"))
    theirs = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("place"), F.lit(0.0).alias("caption"), F.col("value").alias("lm_ppl"), F.col("event_id").alias("lm_event"))
    return review.merge_scores(base, theirs, "place").select("id", "caption", "lm_ppl", "lm_event")


@query("""WITH f AS (SELECT conv_id, string_split(text, ' ') AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE text <> '')
    SELECT doc_id, coalesce(len(m), 0) AS n_missing FROM documents LEFT JOIN f ON conv_id = doc_id AND r = 1""")
def attach_missing(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    failures = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.when(F.col("text") != "", F.split("text", " ")).alias("missing_tokens"))
    return review.payload(review.attach_missing(base, failures, "turn").withColumn("reviewed", F.lit(None).cast("boolean"))).select(F.col("id").alias("doc_id"), F.size("missing_tokens").cast("long").alias("n_missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS source, event_type AS caption FROM events")
def source_copy_if_absent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("caption"), F.parse_json("props").alias("ann"))
    return dataset.with_source_copy(rows, "source", "k").select("event_id", F.expr("variant_get(ann, '$.source', 'string')").alias("source"), "caption")


@query("SELECT DISTINCT unnest(json_keys(props)) AS name FROM events")
def open_row_fields(spark, sf_dir):
    return review.extra_fields(table(spark, sf_dir, "events").select(F.parse_json("props").alias("ann")))


@query("""WITH f AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '')) AS w FROM conversations)
    SELECT token, count(*) AS count FROM (SELECT CASE WHEN instr(w, '-') > 1 AND instr(w, '-') < length(w) THEN split_part(w, '-', 1) ELSE w END AS token FROM f) GROUP BY token""")
def normalized_token_counts(spark, sf_dir):
    rows = providers.morphemes(table(spark, sf_dir, "conversations").select("text"), "text", providers.WhiteSpaceAnalyzer)
    return coverage.frequencies(rows, coverage.normalized_tokens(F.col("morphemes"), normalize=True))


@query("SELECT conv_id, turn, len(m) AS n_missing FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and', 'la', 'de')) AS m FROM conversations)")
def missing_by_morphemes(spark, sf_dir):
    rows = providers.morphemes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", providers.WhiteSpaceAnalyzer)
    return rows.select("conv_id", "turn", F.size(M.missing_morphemes(F.col("morphemes"), Vocabulary(["the", "of", "and", "la", "de"]))).cast("long").alias("n_missing"))


@query("SELECT event_id AS step FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 2")
def kept_checkpoints(spark, sf_dir):
    return training.kept_checkpoints(table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("step")))


# Metrics


def sari_sql(tokens: str) -> str:
    """Mean of the metric over complete pairs; tokens: SQL that cuts the text x."""
    cut = {k: tokens.replace("x.", c) for k, c in (("s", "source"), ("p", "prediction"), ("r", "target"))}
    grams = ", ".join(f"list_distinct(list_transform(range(1, len({k}) - {n} + 2), lambda i: array_to_string({k}[i : i + {n} - 1], chr(31)))) AS {k}{n}" for k in "spr" for n in range(1, 5))
    parts = []
    for n in range(1, 5):
        s, p, r = f"s{n}", f"p{n}", f"r{n}"

        def both(*sets):
            inner = sets[0] if len(sets) == 1 else f"list_intersect({sets[0]}, {sets[1]})"
            return f"len({inner if len(sets) < 3 else f'list_intersect({inner}, {sets[2]})'})"

        sp, sr, pr, spr = both(s, p), both(s, r), both(p, r), both(s, p, r)
        for mine, theirs, shared in ((sp, sr, spr), (f"({both(p)} - {sp})", f"({both(r)} - {sr})", f"({pr} - {spr})"), (f"({both(s)} - {sp})", f"({both(s)} - {sr})", f"({both(s)} - {sp} - {sr} + {spr})")):
            a, b = f"({shared} / greatest(1, {mine}))", f"({shared} / greatest(1, {theirs}))"
            parts.append(f"CASE WHEN {shared} = 0 THEN 0 ELSE 2 * {a} * {b} / ({a} + {b}) END")
    score = f"CASE WHEN len(s) = 0 OR len(p) = 0 OR len(r) = 0 THEN 0 ELSE ({' + '.join(parts)}) / 12 END"
    return f"WITH {PAIRS}, t AS (SELECT {', '.join(f'{v} AS {k}' for k, v in cut.items())} FROM pairs WHERE target IS NOT NULL), g AS (SELECT s, p, r, {grams} FROM t) SELECT count(*) AS rows, round(avg({score}), 9) AS sari FROM g"


def mean_sari(spark, sf_dir, tokenizer):
    rows = complete(spark, sf_dir).select(*[metrics.TOKENIZERS[tokenizer](F.col(c)).alias(c) for c in ("source", "prediction", "target")])
    score = metrics.simplification(F.col("source"), F.col("prediction"), F.col("target"))
    return rows.agg(F.count("*").alias("rows"), F.round(F.avg(score), 9).alias("sari"))


@query(sari_sql("list_transform(range(1, length(x.) + 1), lambda i: substring(x., i, 1))"))
def sari_char(spark, sf_dir):
    return mean_sari(spark, sf_dir, "char")


@query(sari_sql(r"list_filter(string_split_regex(x., '[ \t-\r]+'), lambda w: w <> '')"))
def sari_whitespace(spark, sf_dir):
    return mean_sari(spark, sf_dir, "whitespace")


@query(f"""WITH {PAIRS}, t AS (SELECT row_number() OVER () AS row, list_filter(string_split_regex(prediction, '[ \t-\r]+'), lambda w: w <> '') AS p, list_filter(string_split_regex(target, '[ \t-\r]+'), lambda w: w <> '') AS r FROM pairs WHERE target IS NOT NULL),
    g AS (SELECT row, n, 'p' AS side, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i : i + n - 1], chr(31)))) AS gram FROM t, (VALUES (1), (2), (3), (4)) AS o(n)
      UNION ALL SELECT row, n, 'r', unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], chr(31)))) FROM t, (VALUES (1), (2), (3), (4)) AS o(n)),
    c AS (SELECT row, n, gram, count_if(side = 'p') AS a, count_if(side = 'r') AS b FROM g GROUP BY row, n, gram),
    m AS (SELECT n, sum(least(a, b)) AS hits, sum(a) AS total FROM c GROUP BY n), l AS (SELECT sum(len(p)) AS p, sum(len(r)) AS r FROM t)
    SELECT round(CASE WHEN p >= r THEN 1 ELSE exp(1 - r / p) END * exp((SELECT sum(ln(100 * hits / total)) FROM m) / 4), 9) AS bleu FROM l""")
def bleu_corpus(spark, sf_dir):
    rows = complete(spark, sf_dir).select(T.white_space_tokens(F.col("prediction")).alias("p"), T.white_space_tokens(F.col("target")).alias("r"))
    return metrics.bleu(rows, "p", "r").select(F.round("bleu", 9).alias("bleu"))


#: One step per token of the prediction; the row of the table has, for each token of the target, the longest so far.
COMMON = r"""tokens AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(prediction), '[^a-z0-9]+'), lambda w: w <> '') AS p, list_filter(string_split_regex(lower(target), '[^a-z0-9]+'), lambda w: w <> '') AS r FROM pairs WHERE target IS NOT NULL),
    walk AS (SELECT conv_id, turn, p, r, 0 AS k, list_transform(r, lambda x: 0) AS longest FROM tokens
      UNION ALL SELECT conv_id, turn, p, r, k + 1, list_transform(range(1, len(r) + 1), lambda j: greatest(longest[j], list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN r[i] = p[k + 1] THEN 1 + CASE WHEN i = 1 THEN 0 ELSE longest[i - 1] END ELSE 0 END))))
        FROM walk WHERE k < len(p)),
    common AS (SELECT conv_id, turn, len(p) AS np, len(r) AS nr, coalesce(list_max(longest), 0) AS n FROM walk WHERE k = len(p))"""


@query(f"WITH RECURSIVE {PAIRS}, {COMMON} SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / np) * (n / nr) / (n / np + n / nr) END, 9) AS rouge_l FROM common")
def rouge_l(spark, sf_dir):
    return complete(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l(F.col("prediction"), F.col("target")), 9).alias("rouge_l"))


@query(f"""WITH {PAIRS} SELECT count(*) AS rows, round(avg(CASE WHEN source = prediction THEN 1.0 ELSE 0.0 END), 9) AS copy_rate, round(avg(length(prediction)), 6) AS mean_prediction_length,
    round(avg(length(target)), 6) AS mean_reference_length, round(avg(length(prediction)) / greatest(1.0, avg(length(target))), 9) AS length_ratio FROM pairs WHERE target IS NOT NULL""")
def copy_rate_len_ratio(spark, sf_dir):
    found = metrics.corpus_means(complete(spark, sf_dir), "source", "prediction", "target")
    return found.select("rows", F.round("copy_rate", 9).alias("copy_rate"), F.round("mean_prediction_length", 6).alias("mean_prediction_length"), F.round("mean_reference_length", 6).alias("mean_reference_length"), F.round("length_ratio", 9).alias("length_ratio"))


# Scores


@query("""SELECT o_orderkey, CASE WHEN n = 0 THEN 'Infinity'::DOUBLE ELSE round(t / n, 9) + 0 END AS lm_avg_logprob, CASE WHEN n = 0 THEN 'Infinity'::DOUBLE ELSE round(exp(-t / n), 6) END AS lm_ppl
    FROM (SELECT o_orderkey, count(l_orderkey) AS n, -sum(l_tax * 10) AS t FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""")
def ppl_fields(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (-F.sum(F.col("l_tax") * 10)).alias("t"))
    # one row a key (a null key too): rows of an equal key bring its items once each, to the count and to the sum
    orders = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("copies"))
    n, t = F.coalesce(F.col("copies") * F.col("n"), F.lit(0)), F.col("copies") * F.col("t")
    rows = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", n.alias("n"), t.alias("t"))
    return rows.select("o_orderkey", (F.round(scores.average_logprob(F.col("t"), F.col("n")), 9) + F.lit(0.0)).alias("lm_avg_logprob"), F.round(scores.perplexity(F.col("t"), F.col("n")), 6).alias("lm_ppl"))


@query("SELECT event_id, value AS lm_source_ppl, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY event_id), value) AS lm_target_ppl, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY event_id), value) - value AS lm_delta_ppl FROM events")
def delta_ppl(spark, sf_dir):
    after = F.coalesce(F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id")), F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("lm_source_ppl"), after.alias("lm_target_ppl"))
    return rows.withColumn("lm_delta_ppl", scores.perplexity_change(F.col("lm_source_ppl"), F.col("lm_target_ppl")))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, min(value) AS p0, max(value) AS p100 FROM events GROUP BY event_type")
def percentile_thresholds(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(scores.percentiles(F.col("value"), [0.95, 0.99]).alias("m"), scores.percentile(F.col("value"), -1).alias("p0"), scores.percentile(F.col("value"), 2).alias("p100"))
    return found.select("event_type", F.round(F.col("m")["0.95"], 9).alias("p95"), F.round(F.col("m")["0.99"], 9).alias("p99"), "p0", "p100")


@query("""SELECT l_orderkey, round(sum(l_quantity * (l_linenumber % 2)) / greatest(sum(l_linenumber % 2), 1e-9), 6) AS a, round(sum(l_tax * (l_linenumber % 2)) / greatest(sum(l_linenumber % 2), 1e-9), 6) AS b FROM lineitem GROUP BY l_orderkey""")
def pooled_vectors(spark, sf_dir):
    each = F.struct("l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).alias("v"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("x"))  # an order has few lines
    mean = scores.masked_mean(F.col("x.v"), F.transform("x.l_linenumber", lambda n: n % 2))
    return rows.select("l_orderkey", mean.alias("m")).select("l_orderkey", (F.round(F.col("m")[0], 6) + F.lit(0.0)).alias("a"), (F.round(F.col("m")[1], 6) + F.lit(0.0)).alias("b"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, -l_tax) AS r FROM lineitem),
    s AS (SELECT *, min(CASE WHEN l_linenumber % 3 = 0 THEN r END) OVER (PARTITION BY l_orderkey) AS stop FROM n)
    SELECT l_orderkey, round(-sum(CASE WHEN stop IS NULL OR r <= stop THEN l_tax ELSE 0 END), 6) + 0 AS logprob FROM s GROUP BY l_orderkey""")
def sequence_logprobs(spark, sf_dir):
    each = F.struct("l_linenumber", (-F.col("l_tax").cast("double")).alias("p"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("x"))
    ids = F.concat(F.array(F.lit(0)), F.transform("x.l_linenumber", lambda n: (n % 3).cast("int")))  # the start, then ids of which 0 is the end
    return rows.select("l_orderkey", (F.round(scores.sequence_logprob(F.col("x.p"), ids, 0), 6) + F.lit(0.0)).alias("logprob"))


@query("""SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS similarity
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    joined = x.join(x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after")), "vec_id")
    return joined.select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("after")), 9).alias("similarity"))


@query("""SELECT count(*) AS rows, count_if(similarity < 0.05) AS below FROM (SELECT list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS similarity
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1)""")
def below_threshold(spark, sf_dir):
    flagged = cosine_pairs(spark, sf_dir).withColumn("low", scores.below(F.col("similarity"), 0.05))
    return flagged.agg(F.count("*").alias("rows"), F.count_if("low").alias("below"))


@query("SELECT badge, count(*) AS rows FROM (SELECT CASE WHEN value IS NULL THEN 'na' WHEN value >= 50 THEN 'bad' ELSE 'ok' END AS badge FROM events UNION ALL SELECT CASE WHEN l_discount IS NULL THEN 'na' WHEN l_discount <= 0.03 THEN 'bad' ELSE 'ok' END FROM lineitem) GROUP BY badge")
def badge_counts(spark, sf_dir):
    fluency = table(spark, sf_dir, "events").select(scores.fluency_badge(F.col("value"), 50.0).alias("badge"))
    meaning = table(spark, sf_dir, "lineitem").select(scores.meaning_badge(F.col("l_discount"), 0.03).alias("badge"))
    return fluency.union(meaning).groupBy("badge").agg(F.count("*").alias("rows"))


# Review


VIEW = "view AS (SELECT d.doc_id AS id, d.doc_id AS index, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def view(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("index"), "n_chars", "quality", "toxic")


@query(f"WITH {VIEW} SELECT id, quality FROM view ORDER BY quality ASC NULLS LAST, index LIMIT 50 OFFSET 25")
def review_page_asc(spark, sf_dir):
    return review.page(view(spark, sf_dir), 25, 50, "quality").select("id", "quality")


@query(f"WITH {VIEW} SELECT id, quality FROM view ORDER BY quality DESC NULLS FIRST, index LIMIT 50 OFFSET 25")
def review_page_desc(spark, sf_dir):
    return review.page(view(spark, sf_dir), 25, 50, "quality", descending=True).select("id", "quality")


@query(f"WITH {VIEW} SELECT id FROM view WHERE toxic = 1 AND coalesce(quality, 0) = 0")
def review_filters(spark, sf_dir):
    rows = view(spark, sf_dir).withColumn("missing_tokens", F.when(F.col("toxic") == 1, F.array(F.lit("x")))).withColumn("reviewed", F.col("quality") == 1)
    return review.filtered(rows, missing_only=True, unreviewed_only=True).select("id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view'),
    f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'view')
    SELECT c_custkey AS id, coalesce(e.event_type, c_name) AS caption, coalesce(f.value > 50, false) AS reviewed, e.event_id IS NOT NULL AS edited
    FROM customer LEFT JOIN e ON e.user_id = c_custkey AND e.r = 1 LEFT JOIN f ON f.user_id = c_custkey AND f.r = 1""")
def latest_edits(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("caption"), F.lit(False).alias("reviewed"))
    flag = F.col("event_type") == "view"
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(~flag, F.col("event_type")).alias("caption"), F.when(flag, F.col("value") > 50).alias("reviewed"))
    return review.apply_edits(base, log, field="caption").select("id", "caption", "reviewed", F.col("_edited").alias("edited"))


# Training records


LOGS = "logs AS (SELECT event_id AS step, CASE WHEN event_type = 'click' THEN value END AS loss, CASE WHEN event_type = 'purchase' THEN value END AS eval_loss FROM events)"


def logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    none = F.lit(None).cast("double")
    return e.select(F.col("event_id").alias("step"), F.when(kind == "click", F.col("value")).alias("loss"), F.when(kind == "purchase", F.col("value")).alias("eval_loss"), none.alias("learning_rate"), none.alias("epoch"))


@query(f"WITH {LOGS} SELECT step, loss, eval_loss FROM logs WHERE loss IS NOT NULL OR eval_loss IS NOT NULL")
def loss_log(spark, sf_dir):
    return training.kept_records(logs(spark, sf_dir)).select("step", "loss", "eval_loss")


@query(f"WITH {LOGS} SELECT step, loss FROM logs WHERE loss IS NOT NULL")
def loss_series(spark, sf_dir):
    return training.series(logs(spark, sf_dir), "loss")


@query(f"WITH {LOGS} SELECT step, eval_loss FROM logs WHERE eval_loss IS NOT NULL ORDER BY eval_loss, step LIMIT 1")
def best_eval(spark, sf_dir):
    return training.best_evaluation(logs(spark, sf_dir))


@query(f"""WITH {LOGS}, e AS (SELECT step, eval_loss, min(eval_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM logs WHERE eval_loss IS NOT NULL),
    b AS (SELECT *, least IS NULL OR eval_loss < least AS better FROM e), g AS (SELECT *, sum(better::INT) OVER (ORDER BY step) AS run FROM b),
    w AS (SELECT step, sum((NOT better)::INT) OVER (PARTITION BY run ORDER BY step) AS waited FROM g) SELECT min(step) AS step FROM w WHERE waited >= 3""")
def early_stop_step(spark, sf_dir):
    return training.early_stop(logs(spark, sf_dir))


# Morphology: morphemes made from part names and keys, and rows worked out by hand


def morpheme(**given):
    return tuple(given.get(f) for f in M.FIELDS)


def quoted(x):
    return "NULL" if x is None else f"'{x}'"


def made_morphemes(spark, sf_dir):
    """p_partkey and m: fields that are, by the key, null, empty, a star, or the name in kana."""
    key, name = F.col("p_partkey"), F.translate("p_name", KANA_FROM, KANA_TO)

    def field(n: int) -> F.Column:
        turn = F.floor(key / n) % 4
        return F.when(turn == 0, F.lit("")).when(turn == 1, F.lit("*")).when(turn == 2, F.concat(name, F.lit(f"{n}")))

    given = {"surface": F.col("p_name"), "lemma": field(1), "dictionary_form": field(4), "orthBase": field(16), "kanaBase": field(1), "pronBase": field(4), "kana": field(16), "pron": field(64)}
    return table(spark, sf_dir, "part").select("p_partkey", F.struct(*[given.get(f, F.lit(None).cast("string")).alias(f) for f in M.FIELDS]).alias("m"))


def made_sql(n: int) -> str:
    return f"CASE p_partkey // {n} % 4 WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN translate(p_name, '{KANA_FROM}', '{KANA_TO}') || '{n}' END"


@query(f"SELECT p_partkey, coalesce({', '.join(f"nullif(nullif({made_sql(n)}, ''), '*')" for n in (1, 4, 16))}, p_name) AS base FROM part")
def base_form(spark, sf_dir):
    return made_morphemes(spark, sf_dir).select("p_partkey", M.base_form(F.col("m")).alias("base"))


@query(f"SELECT p_partkey, translate(coalesce(nullif(coalesce(nullif({made_sql(1)}, ''), nullif({made_sql(4)}, '')), '*'), nullif(coalesce(nullif({made_sql(16)}, ''), nullif({made_sql(64)}, '')), '*')), '{T.KATAKANA}', '{T.HIRAGANA}') AS kana FROM part")
def kana_base(spark, sf_dir):
    return made_morphemes(spark, sf_dir).select("p_partkey", M.kana_base(F.col("m")).alias("kana"))


#: Verbs, following surface, and what both become.
CONJUGATIONS = [
    ("書く", "て", "書いて"), ("泳ぐ", "だ", "泳いだ"), ("飲む", "で", "飲んで"), ("話す", "た", "話した"), ("買う", "て", "買って"), ("行く", "た", "行った"), ("食べる", "て", "食べて"), ("見る", "た", "見った"), ("する", "て", "して"),
    ("為る", "ない", "しない"), ("来る", "た", "来た"), ("くる", "ない", "こない"), ("待つ", "ない", "待たない"), ("死ぬ", "ぬ", "死なぬ"), ("起きる", "ない", "起きない"), ("遊ぶ", "て", "遊んで"), ("読む", "は", None), ("犬", "て", None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{f}', {quoted(o)})" for v, f, o in CONJUGATIONS) + ") AS v(lemma, form, out)")
def conjugation_table(spark, sf_dir):
    rows = spark.createDataFrame([(v, f) for v, f, _ in CONJUGATIONS], "lemma string, form string")
    return rows.select("lemma", "form", M.conjugated(F.col("lemma"), F.col("form"), M.verb_class(F.col("lemma"))).alias("out"))


#: Verbs made from part names: a kana and a last kana (some that no verb ends in) by the key, every 50th an irregular one.
IRREGULAR, FORMS, LAST, BEFORE_LAST = ["する", "為る", "来る", "くる", "行く", "いく"], ["て", "で", "た", "だ", "ない", "ぬ", "は"], "".join(M.ENDINGS) + "はてん", "いかけ字"


def ending_sql(k: int) -> str:
    """The ending of a regular verb by the place of its last kana; null for other kana."""
    return "[" + ", ".join(f"'{v[k]}'" for v in M.ENDINGS.values()) + "][nullif(place, 0)]"


@query(f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN {IRREGULAR}[p_partkey // 50 % {len(IRREGULAR)} + 1]
      ELSE p_name || substring('{BEFORE_LAST}', p_partkey // {len(LAST)} % {len(BEFORE_LAST)} + 1, 1) || substring('{LAST}', p_partkey % {len(LAST)} + 1, 1) END AS lemma,
      {FORMS}[p_partkey // 7 % {len(FORMS)} + 1] AS form FROM part),
    p AS (SELECT *, left(lemma, -1) AS stem, instr('{"".join(M.ENDINGS)}', right(lemma, 1)) AS place,
      CASE WHEN lemma IN ('する', '為る') THEN ['し', 'し', 'し'] WHEN lemma = '来る' THEN ['来', '来', '来'] WHEN lemma = 'くる' THEN ['き', 'き', 'こ']
        WHEN right(lemma, 1) = 'る' AND instr('{M.VOWEL_STEMS}', left(right(lemma, 2), 1)) > 0 THEN [left(lemma, -1), left(lemma, -1), left(lemma, -1)] END AS fixed FROM v)
    SELECT p_partkey, lemma, form, CASE
      WHEN form IN ('て', 'で') THEN coalesce(fixed[1] || 'て', CASE WHEN lemma IN ('行く', 'いく') THEN stem || 'って' END, stem || {ending_sql(0)})
      WHEN form IN ('た', 'だ') THEN coalesce(fixed[2] || 'た', CASE WHEN lemma IN ('行く', 'いく') THEN stem || 'った' END, stem || {ending_sql(1)})
      WHEN form IN ('ない', 'ぬ') THEN coalesce(fixed[3], stem || {ending_sql(2)}) || form END AS out FROM p""")
def conjugated_verbs(spark, sf_dir):
    def nth(values, n: int) -> F.Column:
        return F.get(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / n) % len(values)).cast("int"))

    made = F.when(F.col("p_partkey") % 50 == 0, nth(IRREGULAR, 50)).otherwise(F.concat("p_name", nth(BEFORE_LAST, len(LAST)), nth(LAST, 1)))
    rows = table(spark, sf_dir, "part").select("p_partkey", made.alias("lemma"), nth(FORMS, 7).alias("form"))
    return rows.withColumn("out", M.conjugated(F.col("lemma"), F.col("form"), M.verb_class(F.col("lemma"))))


def verb(surface, lemma):
    return morpheme(surface=surface, lemma=lemma, pos1="動詞")


def noun(surface, lemma=None, **more):
    return morpheme(surface=surface, lemma=lemma, pos1="名詞", **more)


CAPTION_TOKENS = ["猫", "2", "文字", "はしる", "て", "もの", "する"]
REPLACEMENTS = {"歩行": "はしる", "執筆": "書く", "巨大": "大きい", "いぬ": "犬"}
CAPTIONS = [
    (1, [noun("猫"), verb("執筆し", "執筆"), noun("て", "て")], "猫書いて"),
    (2, [verb("執筆", "執筆"), noun("猫")], "書く猫"),
    (3, [noun("二", "二"), noun("ABC", "ABC"), noun("鳥", "鳥")], "二文字鳥"),
    (4, [noun("イヌ", "狗", kanaBase="イヌ")], "犬"),
    (5, [noun("白い", "白い"), noun("物", "物"), noun("々", "々")], "白いもの々"),
    (6, [noun("物", "物"), noun("物", "物"), noun("する", "する")], "する"),
    (7, [], ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{o}')" for i, _, o in CAPTIONS) + ") AS v(id, out)")
def replace_caption(spark, sf_dir):
    rows = spark.createDataFrame([(i, m) for i, m, _ in CAPTIONS], f"id int, m array<{M.MORPHEME}>")
    return rows.select("id", M.replaced_caption(F.col("m"), Vocabulary(CAPTION_TOKENS), REPLACEMENTS).alias("out"))


@query("""SELECT conv_id, turn, len(w) AS n_tokens, round(-list_sum(list_transform(w, lambda x: ln(1 + length(x)))), 6) AS lm_total_logprob
    FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM conversations)""")
def provider_scores(spark, sf_dir):
    rows = providers.provided(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "logprobs", "array<double>", providers.LengthScorer)
    return rows.select("conv_id", "turn", F.size("logprobs").cast("long").alias("n_tokens"), F.round(scores.total_logprob(F.col("logprobs")), 6).alias("lm_total_logprob"))


__all__ = ["ORACLES", "QUERIES", "covered", "uncovered_runs"]
