"""Language identification by language-bitmask n-gram filters.

Fitting counts the n-grams of letters (a run of anything else is one space) of a bounded sample of labelled rows and
gives each language the n-grams that are frequent in it. One Bloom filter holds them all: where a plain filter has a
bit, this has a mask with a bit per language, so the AND of an n-gram's places names all languages that (may) contain
it. A text's n-grams are looked up together; per language the bits are counted and corrected for the share that the
filter gives by chance, (share - fp) / (1 - fp); the largest decides, the first by name on ties.

Nulls: texts that are null or have no letter are `und` with score 0, also if nothing was learned. Rows without a
label are not learned from. Rows that repeat are predicted each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, begins, blocks, mixed, overlaid, tidied

SIZES = (3, 4)
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the number of the text of each, and which texts have a letter."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 2
    points = np.frombuffer(("".join([f" {t} " for t in lower])).encode("utf-32-le"), "<u4").astype(np.int64)
    letter = is_letter()[points]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    points = np.where(letter, points, 32)
    keep = letter | np.append(True, letter[:-1])  # of each run of others, one
    keep[np.cumsum(sizes) - sizes] = True
    points, text_of = points[keep], text_of[keep]
    hashes, owners = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(BASES[0]) + points[j : j + m].astype(np.uint64)
        same = text_of[:m] == text_of[n - 1 :]
        hashes.append(mixed(h[same]))
        owners.append(text_of[:m][same])
    has = np.zeros(len(texts), bool)
    has[text_of[points != 32]] = True
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)]), has


@dataclass
class Model:
    """languages in order; places: the filter, a mask of languages each; hashes: lookups per n-gram; fp: by language, the chance of a false hit."""

    languages: list[str]
    places: np.ndarray
    hashes: int
    fp: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        size, found = np.uint64(len(self.places)), None
        step = mixed(grams ^ np.uint64(BASES[1])) | np.uint64(1)
        for k in range(self.hashes):
            got = self.places[((grams + np.uint64(k) * step) % size).astype(np.int64)]
            found = got if found is None else found & got
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        grams, owner, has = ngrams([t or "" for t in texts])
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        masks = self.masks(grams)
        n = np.maximum(1, np.bincount(owner, minlength=len(texts)))
        share = np.empty((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            hit = (masks >> masks.dtype.type(k)) & masks.dtype.type(1)
            share[k] = np.bincount(owner, hit, len(texts)) / n
        fp = self.fp[:, None]
        right = np.clip((share - fp) / np.maximum(1 - fp, 1e-9), 0, 1)
        best = np.argmax(right, axis=0)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, right[best, np.arange(len(texts))], 0.0).tolist()


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: lang, text to lang, gram, n, summed by block."""
    for batch in blocks(batches):
        langs = np.array(batch.column("lang").to_pylist())
        for lang in np.unique(langs).tolist():
            grams, _, _ = ngrams([batch.column("text")[i].as_py() or "" for i in np.flatnonzero(langs == lang).tolist()])
            found, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2000, most_grams: int = 20_000, least_share: float = 0.2, bits: int = 20, hashes: int = 3) -> Model:
    """Learns from docs' rows that have a label: per_language distinct texts of each language at most, those of the smallest hash.

    A language gets its most_grams most frequent n-grams, without those whose share of its n-grams is under least_share
    of their largest share in any language. The filter has 2**bits places. 64 languages at most.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["texts"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).limit(65).collect()}  # a row per language
    if len(sizes) > 64:
        raise ValueError("64 languages at most")
    drawn = F.lit(False)  # about four times per_language texts, so that few are shuffled; a text's copies are one row
    for name, size in sizes.items():
        drawn = drawn | ((F.col("lang") == name) & (F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 4 * per_language / max(size, 1))))))
    texts = rows.where(drawn).groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    sample = texts.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text")
    counts = sample.mapInArrow(tidied(counting), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    of_all = F.sum("n").over(Window.partitionBy("lang"))
    found = counts.withColumn("all", of_all).withColumn("nth", top).where(F.col("nth") <= most_grams).select("lang", "gram", (F.col("n") / F.col("all")).alias("share")).toArrow()
    names, grams, shares = found["lang"].to_pylist(), found["gram"].to_numpy().view(np.uint64), found["share"].to_numpy()
    languages = sorted(set(names))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * t().itemsize)
    model = Model(languages, np.zeros(1 << bits, kind), hashes, np.zeros(len(languages)))
    if not languages:
        return model
    number = np.array([languages.index(x) for x in names])
    order = np.lexsort((number, grams))
    grams, shares, number = grams[order], shares[order], number[order]
    group = np.cumsum(begins(grams)) - 1
    largest = np.zeros(group[-1] + 1)
    np.maximum.at(largest, group, shares)
    held = shares >= least_share * largest[group]
    grams, number = grams[held], number[held]
    step = mixed(grams ^ np.uint64(BASES[1])) | np.uint64(1)
    for k in range(hashes):
        np.bitwise_or.at(model.places, ((grams + np.uint64(k) * step) % np.uint64(1 << bits)).astype(np.int64), kind(1) << number.astype(kind))
    model.fp = np.array([np.count_nonzero((model.places >> kind(k)) & kind(1)) / (1 << bits) for k in range(len(languages))]) ** hashes
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced. The model, some MB by its bits, goes to all executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(tidied(run), rows.select("row").schema.add("lang_pred", "string").add("score", "double"))
    return overlaid(out, "row", docs.columns, {"lang_pred": F.col("lang_pred"), "score": F.col("score")})
