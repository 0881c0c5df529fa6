"""Text rules as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode white space, and the four separators that it leaves out.
WHITE_SPACE = "(?U)[\\s\\x1c-\\x1f]"
#: Fixed: katakana that shift to hiragana by 0x60.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Fixed: values of the kanji that write numbers.
KANJI_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
KANJI_UNITS = {"十": 10, "百": 100, "千": 1000}
KANJI_LARGE_UNITS = {"万": 10_000, "億": 100_000_000}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def without_white_space(text: Column) -> Column:
    """Deletes all Unicode white space."""
    return F.regexp_replace(text, WHITE_SPACE, "")


def stripped(text: Column) -> Column:
    """Deletes Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def characters(text: Column) -> Column:
    """Code points as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def white_space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITE_SPACE}+"), lambda w: w != "")


def to_hiragana(text: Column) -> Column:
    """Shifts katakana; long marks and rare letters stay."""
    return F.translate(text, KATAKANA, HIRAGANA)


def without_gloss(text: Column) -> Column:
    """Head before the first hyphen, if head and tail aren't empty."""
    at = F.locate("-", text)
    return F.when((at > 1) & (at < F.length(text)), F.substring_index(text, "-", 1)).otherwise(text)


def is_latin(text: Column) -> Column:
    """Only ASCII or full-width Latin letters, one at least."""
    return text.rlike("^[A-Za-zＡ-Ｚａ-ｚ]+$") & ~text.contains("\n")


def _value(char: Column, values: dict[str, int]) -> Column:
    out = None
    for name, value in values.items():
        hit = char == name
        out = F.when(hit, F.lit(value).cast("long")) if out is None else out.when(hit, F.lit(value).cast("long"))
    return out


def kanji_number(text: Column) -> Column:
    """The number that kanji write, null for other text. A digit replaces the one before it: digits aren't positional."""
    known = "^[" + "".join([*KANJI_DIGITS, *KANJI_UNITS, *KANJI_LARGE_UNITS]) + "]+$"
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("number"))

    def step(s: Column, char: Column) -> Column:
        digit, unit, large = _value(char, KANJI_DIGITS), _value(char, KANJI_UNITS), _value(char, KANJI_LARGE_UNITS)
        whole = s["section"] + s["number"]
        times = F.when(s["number"] == 0, F.lit(1).cast("long")).otherwise(s["number"])
        return (
            F.when(digit.isNotNull(), F.struct(s["total"].alias("total"), s["section"].alias("section"), digit.alias("number")))
            .when(unit.isNotNull(), F.struct(s["total"].alias("total"), (s["section"] + times * unit).alias("section"), zero.alias("number")))
            .otherwise(F.struct((s["total"] + F.when(whole == 0, F.lit(1).cast("long")).otherwise(whole) * F.coalesce(large, zero)).alias("total"), zero.alias("section"), zero.alias("number")))
        )

    value = F.aggregate(characters(text), start, step, lambda s: s["total"] + s["section"] + s["number"])
    return F.when(text.rlike(known), value)


def mend_artifacts(text: Column) -> Column:
    """Compounds with 物 that replacement leaves, one pass each in this order."""
    text = F.regexp_replace(text, "([ぁ-ん一-龥]+い)物", "$1もの")
    text = F.replace(text, F.lit("物々"), F.lit("もの"))
    text = F.regexp_replace(text, "物{2,}", "もの")
    return F.replace(text, F.lit("ものする"), F.lit("する"))
