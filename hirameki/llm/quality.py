"""Quality rules: a table of thresholds compiled into one projection, without user functions.

All counts come from array and string functions over a row's own text, so nothing is shuffled. Each word is hashed
once, and a window of five words by the hashes of its words; only where two windows' hashes are equal are the words
themselves compared.

Nulls and empty texts have no words and fail the base rule. Rows that repeat are judged each. The result has the
columns given and the new ones; columns of docs that have the names of new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed: frequent words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in a is that for on with as was it by be are at from this or an have not which but he his they we you
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
le la les de des et un une en du dans que qui est pour pas par sur au plus ce il elle ne se son avec sont ou
el los las y del que en un una por con para como se su al lo más pero sus es no ha
""".split()

#: (metric, least, most); None: no bound. A metric is a ratio or count that metrics() names.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 2, 20),
    ("symbols_per_word", None, 0.1),
    ("bangs_per_word", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
]


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_list(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * len(SPACES[1:])), " "), "")


def window_hashes(size: int) -> Column:
    """Of all windows of so many words a hash of the words' hashes, in order. Needs the column h (hash of each word)."""
    starts = F.sequence(F.lit(0), F.size("h") - size)
    return F.when(F.size("h") >= size, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(size)])))


def sorted_windows() -> Column:
    """(hash, place) of all windows, sorted. Needs the column windows (hashes)."""
    return F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(size: int) -> Column:
    """Words in windows that have an equal neighbour. Needs the columns words and sorted."""
    none = F.array().cast("array<int>")

    def words(w: Column) -> Column:
        return F.slice(F.col("words"), w["i"] + 1, F.lit(size))

    pairs = F.zip_with(
        F.slice(F.col("sorted"), F.lit(1), F.size("sorted") - 1),
        F.slice(F.col("sorted"), F.lit(2), F.size("sorted") - 1),
        lambda a, b: F.when((a["h"] == b["h"]) & (words(a) == words(b)), F.array(a["i"], b["i"])).otherwise(none),
    )
    places = F.array_sort(F.array_distinct(F.flatten(pairs)))
    start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(size), p - s["last"])).alias("n")), lambda s: s["n"])


def metrics() -> dict[str, Column]:
    """What thresholds can name, over the counts of counted()."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "bangs_per_word": F.col("n_bangs") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    }


def compiled(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    """True where every metric is within its bounds."""
    known, verdict = metrics(), F.lit(True)
    for name, least, most in thresholds:
        if name not in known:
            raise ValueError(f"unknown metric: {name}")
        for bound, holds in ((least, known[name] >= F.lit(least)), (most, known[name] <= F.lit(most))):
            if bound is not None:
                verdict = verdict & holds
    return verdict


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_stop_words", "n_lines")


def judge(docs: DataFrame, text: str = "text", thresholds: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """docs with the COUNTS (long), base_failed (fewer than 10 words, or over 20 % of them repeated) and kept."""
    t, size = F.coalesce(F.col("text"), F.lit("")), 5
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    # a line has a word if something is left when white space goes from its ends
    rows = rows.select("row", t.alias("text"), word_list(t).alias("words"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    rows = rows.withColumn("windows", window_hashes(size)).drop("h")
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_windows())).drop("windows")
    rows = rows.withColumn("n_repeat_words", F.coalesce(_covered(size), F.lit(0)).cast("long")).drop("sorted", "words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(THRESHOLDS if thresholds is None else thresholds))
    new = [*COUNTS, "base_failed", "kept"]
    # a list of one struct, taken apart again: a filter on the verdict stays above, else it would repeat all expressions
    once = rows.select("row", F.inline(F.array(F.struct(*new))))
    return once.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *new)


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of judge()."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    columns = {
        "n_words": "n_words", "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "bangs_per_word": "n_bangs / greatest(n_words, 1)", "stop_word_ratio": "n_stop_words / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    rules = " AND ".join(f"{columns[n]} {op} {b}" for n, lo, hi in THRESHOLDS for op, b in ((">=", lo), ("<=", hi)) if b is not None)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {source}),
    w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \t-\r]', '', 'g') <> '') AS lines FROM d),
    win AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM
              (SELECT r, i, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w))),
    rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM win, range(5) AS s(j) WHERE n > 1 GROUP BY r),
    c AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs, len(lines)::BIGINT AS n_lines,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM f
    """
