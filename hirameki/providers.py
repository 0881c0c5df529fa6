"""Models and analyzers behind one interface: a provider turns batches of texts into a column, once per row.

The stubs here are rules for tests. They are no morphology and no model, and say nothing about quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirameki.functions.morphology import FIELDS, MORPHEME


class Provider(Protocol):
    """Made once per Python worker by its factory; takes texts, gives a value for each."""

    def __call__(self, texts: list[str | None]) -> list: ...


def provided(rows: DataFrame, text: str, name: str, kind: str, factory: Callable[[], Provider], batch: int = 64) -> DataFrame:
    """rows with a column of a provider's values; kind is its type. Texts cross to Python once, batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            texts = b.column("text").to_pylist()
            values = [v for i in range(0, len(texts), batch) for v in provider(texts[i : i + batch])]
            if len(values) != len(texts):
                raise ValueError(f"the provider gave {len(values)} values for {len(texts)} texts")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(values, arrow)], ["row", name])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark_type = _parse_datatype_string(kind)
    arrow = to_arrow_type(spark_type)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return packed.mapInArrow(run, packed.select("row").schema.add(name, spark_type)).select("row.*", name)


def morphemes(rows: DataFrame, text: str, factory: Callable[[], Provider], name: str = "morphemes") -> DataFrame:
    return provided(rows, text, name, f"array<{MORPHEME}>", factory)


def surfaces(rows: DataFrame, text: str, factory: Callable[[], Provider], name: str) -> DataFrame:
    """rows with the surfaces of an analyzer's morphemes."""
    made = morphemes(rows, text, factory, "_morphemes")
    return made.withColumn(name, F.filter(F.transform("_morphemes", lambda m: m["surface"]), lambda t: t != "")).drop("_morphemes")


class TaggerAnalyzer:
    """Morphemes of a MeCab tagger by the fugashi library, where that is installed; options go to the tagger.

    The tagger takes its settings file and dictionary from the options, else from MECABRC and MECAB_DICDIR. A dictionary
    whose features have no names gives surfaces alone.
    """

    def __init__(self, options: str = ""):
        import os

        try:
            import fugashi
        except ImportError as e:
            raise RuntimeError("this analyzer needs the fugashi library and a dictionary") from e
        given = [f"{flag} {os.environ[name]}" for flag, name in (("-r", "MECABRC"), ("-d", "MECAB_DICDIR")) if not options and os.environ.get(name)]
        options = options or " ".join(given)
        try:
            self.tagger = fugashi.Tagger(options)
        except RuntimeError:
            self.tagger = fugashi.GenericTagger(options)

    def __call__(self, texts: list[str | None]) -> list:
        def field(token, name: str) -> str | None:
            value = token.surface if name == "surface" else getattr(token.feature, name, None)
            return None if value is None else str(value)

        return [[{f: field(t, f) for f in FIELDS} for t in self.tagger(x or "")] for x in texts]


class WhiteSpaceAnalyzer:
    """Stub: words between white space, each its own base form."""

    def __call__(self, texts: list[str | None]) -> list:
        return [[{f: w if f == "surface" else None for f in FIELDS} for w in (t or "").split()] for t in texts]


class RuleSimplifier:
    """Stub for a text-to-text model: replaces words by a table."""

    def __init__(self, table: dict[str, str]):
        self.table = table

    def __call__(self, texts: list[str | None]) -> list:
        return [" ".join(self.table.get(w, w) for w in (t or "").split(" ")) for t in texts]


class CopySampler:
    """Stub for a sampling model: of each text the text itself and its words in reverse, two sequences with scores."""

    def __call__(self, texts: list[str]) -> list[tuple[str, float | None]]:
        return [pair for t in texts for pair in ((t, -1.0), (" ".join(reversed(t.split(" "))), -2.0))]


class LengthScorer:
    """Stub for a language model: each token's log probability is minus the logarithm of one more than its length."""

    def __call__(self, texts: list[str | None]) -> list:
        import math

        return [[-math.log(1 + len(w)) for w in (t or "").split()] for t in texts]
