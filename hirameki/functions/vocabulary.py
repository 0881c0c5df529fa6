"""Segmentation by a closed vocabulary, as folds over the characters of a text.

A fold keeps the last characters and the costs of the last few positions (as many as the longest token has characters),
and writes down in one letter which token it chose for each position; a second fold walks back over those letters. So no
position is searched for and no run copied: cost grows with the text's length, but for the string of letters, which
grows by copying. The vocabulary is a literal set in the plan, whose size is checked, or comes from a table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirameki.errors import DataContractError
from hirameki.functions.text import characters, let

#: Tokens that may be literals in a plan.
MOST_TOKENS = 50_000


@dataclass
class Vocabulary:
    """Distinct tokens that aren't empty."""

    tokens: Iterable[str]
    by_length: dict[int, list[str]] = field(init=False)

    def __post_init__(self):
        self.tokens = sorted({t for t in self.tokens if t})
        if not self.tokens:
            raise DataContractError("the vocabulary is empty")
        if len(self.tokens) > MOST_TOKENS:
            raise DataContractError(f"{len(self.tokens)} tokens; beyond {MOST_TOKENS} a vocabulary is a table: coverage.with_known")
        by_length = defaultdict(list)
        for t in self.tokens:
            by_length[len(t)].append(t)
        self.by_length = dict(sorted(by_length.items(), reverse=True))

    @property
    def longest(self) -> int:
        return max(self.by_length)

    @property
    def lengths(self) -> list[int]:
        """From the longest."""
        return list(self.by_length)

    def has(self, text: Column) -> Column:
        return text.isin(list(self.tokens))

    def has_of(self, text: Column, length: int) -> Column:
        """Whether a text of this length is a token."""
        return text.isin(self.by_length[length])


@dataclass
class RowVocabulary:
    """Tokens of a table of any size: a column with those that occur in the row's text, an array for each length (see coverage.with_known).

    A lookup costs as much as the text has distinct tokens of the length, so it is meant for captions and not for books.
    """

    lengths: list[int]
    known: Column

    @property
    def longest(self) -> int:
        return max(self.lengths)

    def has(self, text: Column) -> Column:
        return F.exists(self.known, lambda of: F.array_contains(of, text))

    def has_of(self, text: Column, length: int) -> Column:
        return F.coalesce(F.array_contains(F.get(self.known, self.lengths.index(length)), text), F.lit(False))


Tokens = Vocabulary | RowVocabulary


#: The letter of an unknown character, and the first of those that stand for tokens, by the place of their length.
UNKNOWN, FIRST_LETTER = "0", 0x100


def _ends(vocabulary: Tokens, last: Column):
    """For each length, from the longest: whether the last characters end in a token of that length."""
    for length in vocabulary.lengths:
        yield length, (F.length(last) >= length) & vocabulary.has_of(F.substring(last, -length, length), length)


def _before(states: Column, length: int) -> Column:
    """The state so many characters before; null before the text."""
    return F.try_element_at(states, F.lit(-length))


def _pushed(states: Column, state: Column, keep: int) -> Column:
    """states with one more, of which the last keep stay."""
    return F.concat(F.when(F.size(states) >= keep, F.slice(states, -(keep - 1), keep - 1) if keep > 1 else F.slice(states, 1, 0)).otherwise(states), F.array(state))


def _grown(last: Column, char: Column, keep: int) -> Column:
    return F.concat(F.substring(last, -(keep - 1), keep - 1) if keep > 1 else F.lit(""), char)


def covered(text: Column, vocabulary: Tokens) -> Column:
    """Whether tokens tile the text; the empty text is tiled."""
    keep = vocabulary.longest

    def step(s: Column, char: Column) -> Column:
        last = _grown(s["last"], char, keep)

        def reached(x: Column) -> Column:
            reach = F.lit(False)
            for length, ends in _ends(vocabulary, x):
                reach = reach | (F.coalesce(_before(s["reached"], length), F.lit(False)) & ends)
            return F.struct(x.alias("last"), _pushed(s["reached"], reach, keep).alias("reached"))

        return let(last, reached)

    start = F.struct(F.lit("").alias("last"), F.array(F.lit(True)).alias("reached"))
    return F.when(text.isNotNull(), F.aggregate(characters(text), start, step, lambda s: F.element_at(s["reached"], -1)))


def _letters(vocabulary: Tokens) -> dict[int, str]:
    return {length: chr(FIRST_LETTER + i) for i, length in enumerate(vocabulary.lengths)}


def _chosen(chars: Column, vocabulary: Tokens, unknown: bool) -> Column:
    """A letter for each character: what the best tiling of the text up to it ends in.

    The best has the least cost, on ties the longest token. Cost: unknown characters, or tokens where none may be
    unknown; then a character that no tiling ends at has the letter of an unknown one.
    """
    keep, letters, none = vocabulary.longest, _letters(vocabulary), F.lit(None).cast("int")

    def step(s: Column, char: Column) -> Column:
        def moved(last: Column) -> Column:
            def option(cost: Column, rank: int, letter: str) -> Column:
                return F.struct(cost.alias("cost"), F.lit(rank).alias("rank"), F.lit(letter).alias("letter"))

            options = [option(_before(s["costs"], 1) + 1, 0, UNKNOWN)] if unknown else []
            for length, ends in _ends(vocabulary, last):
                cost = _before(s["costs"], length)
                options.append(F.when(cost.isNotNull() & ends, option(cost if unknown else cost + 1, -length, letters[length])))
            options.append(F.lit(None).cast("struct<cost:int,rank:int,letter:string>"))

            def pushed(best: Column) -> Column:
                new = F.struct(last.alias("last"), _pushed(s["costs"], best["cost"], keep).alias("costs"), F.concat(s["letters"], F.coalesce(best["letter"], F.lit(UNKNOWN))).alias("letters"))
                return new

            return let(F.least(*options), pushed)

        return let(_grown(s["last"], char, keep), moved)

    start = F.struct(F.lit("").alias("last"), F.array(F.lit(0)).alias("costs"), F.lit("").alias("letters"))
    return F.aggregate(chars, start, step, lambda s: F.struct(s["letters"].alias("letters"), F.element_at(s["costs"], -1).alias("cost")))


def _walked(letters: Column, vocabulary: Tokens) -> Column:
    """Of each character, by walking back from the end: `b` a token begins, `i` inside one, `u` unknown. letters: an array."""
    lengths = F.create_map(*[F.lit(x) for length, letter in _letters(vocabulary).items() for x in (letter, length)])

    def step(s: Column, letter: Column) -> Column:
        inside = s["left"] > 0
        left = F.when(inside, s["left"] - 1).otherwise(F.coalesce(F.try_element_at(lengths, letter), F.lit(1)) - 1)
        mark = F.when(~inside & (letter == UNKNOWN), "u").when(left == 0, "b").otherwise("i")
        return F.struct(left.alias("left"), F.concat(s["marks"], mark).alias("marks"))

    start = F.struct(F.lit(0).alias("left"), F.lit("").alias("marks"))
    return F.aggregate(F.reverse(letters), start, step, lambda s: F.reverse(characters(s["marks"])))


def _stretches(chars: Column, starts: Column, ends: Column) -> Column:
    """The texts from each start up to each end."""
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), ""))


def uncovered_runs(text: Column, vocabulary: Tokens) -> Column:
    """Unknown runs, in order, of the tiling with the fewest unknown characters (on ties the longest last token wins)."""

    def runs(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(x["marks"]) - 1)

        def at(i: Column, mark: str) -> Column:
            return F.coalesce(F.get(x["marks"], i) == mark, F.lit(False))

        starts = F.filter(places, lambda i: at(i, "u") & ~at(i - 1, "u"))
        ends = F.transform(F.filter(places, lambda i: at(i, "u") & ~at(i + 1, "u")), lambda i: i + 1)
        return _stretches(x["chars"], starts, ends)

    def found(chars: Column) -> Column:
        marked = let(characters(_chosen(chars, vocabulary, True)["letters"]), lambda letters: _walked(letters, vocabulary))
        return let(F.struct(chars.alias("chars"), marked.alias("marks")), runs)

    empty = F.array().cast("array<string>")
    return F.when(F.length(text) == 0, empty).when(text.isNotNull(), let(characters(text), found))


def segments(text: Column, vocabulary: Tokens) -> Column:
    """Tokens that tile the text, null if none do: the longest last token that is possible, before it the fewest tokens
    (on ties the longest last one). So the whole need not have the fewest."""
    letters_of = _letters(vocabulary)

    def cut(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x["marks"]) - 1), lambda i: F.get(x["marks"], i) == "b")
        return let(starts, lambda s: _stretches(x["chars"], s, F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.size(x["marks"])))))

    def found(chars: Column) -> Column:
        def ended(best: Column) -> Column:
            letters = characters(best["letters"])

            def last(x: Column) -> Column:
                """The letter of the longest last token before which the text is tiled: a place is if its letter isn't that of an unknown one, or it is the start."""
                options = []
                for length, letter in letters_of.items():
                    tail = F.array_join(F.slice(chars, F.greatest(F.size(chars) - length + 1, F.lit(1)), F.lit(length)), "")
                    tiled = (F.size(chars) == length) | F.coalesce(F.get(x, F.size(chars) - length - 1) != UNKNOWN, F.lit(False))
                    options.append(F.when((F.size(chars) >= length) & tiled & vocabulary.has_of(tail, length), F.lit(letter)))
                return F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.array(F.coalesce(*options)))

            marked = let(letters, lambda x: let(last(x), lambda y: _walked(y, vocabulary)))
            return F.when(best["cost"].isNotNull(), let(F.struct(chars.alias("chars"), marked.alias("marks")), cut))

        return let(_chosen(chars, vocabulary, False), ended)

    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(text.isNotNull(), let(characters(text), found))
