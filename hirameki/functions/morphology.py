"""Rules over morphemes: base forms, normalisation, conjugation and replacement.

A text's morphemes are one column, an array of MORPHEME structs that a provider makes (see providers); everything
after it is native columns. Any field may be null, empty or `*`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirameki.functions import text as T
from hirameki.functions.vocabulary import Vocabulary

FIELDS = ("surface", "lemma", "dictionary_form", "orthBase", "kanaBase", "pronBase", "kana", "pron", "pos1", "pos", "cType")
MORPHEME = f"struct<{','.join(f'{f}:string' for f in FIELDS)}>"

#: Fixed: lemmas that are written in kana, colours that are adjectives, and forms of zero.
LEMMAS = {"有る": "ある", "為る": "する", "居る": "いる", "成る": "なる"}
COLOURS = {"白": "白い", "黒": "黒い", "赤": "赤い", "青": "青い"}
ZEROS = {"ゼロ": "0", "０": "0", "〇": "0", "零": "0"}
#: Fixed: kana before る that mark a verb of the vowel class.
VOWEL_STEMS = "いきぎしじちぢにひびぴみりえけげせぜてでねへべぺめれ"
#: Fixed: by the last kana of a verb: endings before て and た, and the kana before ない.
ENDINGS = {
    "う": ("って", "った", "わ"), "つ": ("って", "った", "た"), "る": ("って", "った", "ら"), "む": ("んで", "んだ", "ま"), "ぶ": ("んで", "んだ", "ば"),
    "ぬ": ("んで", "んだ", "な"), "く": ("いて", "いた", "か"), "ぐ": ("いで", "いだ", "が"), "す": ("して", "した", "さ"),
}


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _known(x: Column) -> Column:
    return F.nullif(_given(x), F.lit("*"))


def _mapped(x: Column, values: dict[str, str]) -> Column:
    """The value of x, null if it has none."""
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[x] if values else F.lit(None).cast("string")


def base_form(m: Column) -> Column:
    return F.coalesce(_known(m["lemma"]), _known(m["dictionary_form"]), _known(m["orthBase"]), m["surface"])


def kana_base(m: Column) -> Column:
    """Hiragana of the base form; a given `*` hides what would come after it within its pair."""
    first, second = F.coalesce(_given(m["kanaBase"]), _given(m["pronBase"])), F.coalesce(_given(m["kana"]), _given(m["pron"]))
    return T.to_hiragana(F.coalesce(F.nullif(first, F.lit("*")), F.nullif(second, F.lit("*"))))


def plain_base(m: Column) -> Column:
    return T.without_gloss(base_form(m))


def number_text(text: Column) -> Column:
    return T.kanji_number(text).cast("string")


def missing_morphemes(morphemes: Column, vocabulary: Vocabulary) -> Column:
    """Base forms that neither as such, nor in kana, nor as a number are tokens; order and repetitions stay."""

    def known(m: Column) -> Column:
        def any_form(base: Column) -> Column:
            return F.exists(F.array(base, kana_base(m), number_text(base)), lambda f: F.coalesce(vocabulary.has(f), F.lit(False)))

        return T.let(plain_base(m), any_form)

    return F.filter(F.transform(F.filter(morphemes, lambda m: ~known(m)), plain_base), lambda b: b != "")


def normalized(m: Column, lemma: bool = True, kana: bool = False, numbers: bool = False) -> Column:
    """A token's normal form without a vocabulary: kana wins over all, numbers are read from what came out."""
    text = T.without_gloss(base_form(m) if lemma else m["surface"])
    text = F.coalesce(_mapped(text, LEMMAS), text)
    text = F.coalesce(_given(kana_base(m)), text) if kana else text
    return F.coalesce(number_text(text), text) if numbers else text


def normalized_to(m: Column, vocabulary: Vocabulary, lemma: bool = True, kana: bool = False, numbers: bool = False) -> Column:
    """A token's normal form towards a vocabulary: other forms only where they are tokens."""
    text = T.without_gloss(base_form(m) if lemma else m["surface"])
    text = F.coalesce(_mapped(text, LEMMAS), text)
    for values in (COLOURS, ZEROS):
        text = F.coalesce(_mapped(text, {k: v for k, v in values.items() if v in set(vocabulary.tokens)}), text)
    out = F.when(vocabulary.has(text), text)
    if kana:
        out = out.when(vocabulary.has(kana_base(m)), kana_base(m))
    if numbers:
        out = out.when(vocabulary.has(number_text(text)), number_text(text))
    return out.otherwise(text)


def is_verb(m: Column) -> Column:
    return F.coalesce(m["pos1"].startswith("動詞"), F.lit(False)) | F.coalesce(m["pos"].startswith("動詞"), F.lit(False))


def verb_class_of(m: Column) -> Column:
    """suru, kuru, ichidan or godan by the conjugation type; null for other words."""
    c = F.coalesce(m["cType"], F.lit(""))
    kind = F.when(c.contains("サ行変格"), "suru").when(c.contains("カ行変格"), "kuru").when(c.startswith("上一段") | c.startswith("下一段"), "ichidan").otherwise("godan")
    return F.when(is_verb(m), kind)


def verb_class(lemma: Column, analyses: Column | None = None) -> Column:
    """Class of a dictionary form. analyses: its morphemes; where they are a single one, that decides (also for null)."""
    guess = F.when((F.length(lemma) >= 2) & lemma.endswith("る") & F.substring(lemma, -2, 1).isin(list(VOWEL_STEMS)), "ichidan").otherwise("godan")
    if analyses is not None:
        guess = F.when(F.size(analyses) == 1, verb_class_of(F.try_element_at(analyses, F.lit(1)))).otherwise(guess)
    return F.when(lemma.isin("する", "為る"), "suru").when(lemma.isin("来る", "くる"), "kuru").otherwise(guess)


def conjugated(lemma: Column, form: Column, kind: Column) -> Column:
    """The verb before a following surface (て で た だ ない ぬ), null if it can't be."""
    te, ta, negative = form.isin("て", "で"), form.isin("た", "だ"), form.isin("ない", "ぬ")
    stem, last = F.left(lemma, F.length(lemma) - 1), F.right(lemma, F.lit(1))
    written = lemma == "来る"

    def of(values: dict[str, str]) -> Column:
        return F.concat(stem, _mapped(last, values))

    plain = lemma.isin("行く", "いく")
    te_form = (
        F.when(kind == "suru", "して").when(kind == "kuru", F.when(written, "来て").otherwise("きて")).when(kind == "ichidan", F.concat(stem, F.lit("て")))
        .when(plain, F.concat(stem, F.lit("って"))).otherwise(of({k: v[0] for k, v in ENDINGS.items()}))
    )
    ta_form = (
        F.when(kind == "suru", "した").when(kind == "kuru", F.when(written, "来た").otherwise("きた")).when(kind == "ichidan", F.concat(stem, F.lit("た")))
        .when(plain, F.concat(stem, F.lit("った"))).otherwise(of({k: v[1] for k, v in ENDINGS.items()}))
    )
    before = (
        F.when(kind == "suru", "し").when(kind == "kuru", F.when(written, "来").otherwise("こ")).when(kind == "ichidan", stem).otherwise(of({k: v[2] for k, v in ENDINGS.items()}))
    )
    return F.when(kind.isNotNull(), F.when(te, te_form).when(ta, ta_form).when(negative, F.concat(before, form)))


def replaced_token(m: Column, vocabulary: Vocabulary, replacements: dict[str, str]) -> Column:
    """A replacement by base form, kana or number; else the surface if one of them is a token; else `文字` for Latin letters if that is a token; else the base form."""
    latin = (lambda base: F.when(T.is_latin(base), "文字")) if "文字" in set(vocabulary.tokens) else (lambda _: F.lit(None).cast("string"))

    def of(x: Column) -> Column:
        forms = [x["base"], x["kana"], x["number"]]
        known = F.exists(F.array(*forms), lambda f: F.coalesce(vocabulary.has(f), F.lit(False)))
        return F.coalesce(*[_mapped(f, replacements) for f in forms], F.when(known, m["surface"]), latin(x["base"]), x["base"])

    return T.let(plain_base(m), lambda base: T.let(F.struct(base.alias("base"), _given(kana_base(m)).alias("kana"), number_text(base).alias("number")), of))


def replaced_caption(morphemes: Column, vocabulary: Vocabulary, replacements: dict[str, str], classes: dict[str, str | None] | None = None) -> Column:
    """A caption with tokens replaced: a verb with a replacement takes the next surface with it if that conjugates.

    classes: verb classes of replacements that an analyzer gave (None: no verb); others are guessed by their form.
    """
    n = F.size(morphemes)

    def kind(lemma: Column) -> Column:
        known = {k: v for k, v in (classes or {}).items() if v}
        other = [k for k, v in (classes or {}).items() if not v]
        fixed = lemma.isin("する", "為る", "来る", "くる")
        no_verb = lemma.isin(other) if other else F.lit(False)
        return F.when(fixed, verb_class(lemma)).when(no_verb, F.lit(None).cast("string")).otherwise(F.coalesce(_mapped(lemma, known), verb_class(lemma)))

    def step(s: Column, i: Column) -> Column:
        m, after = F.element_at(morphemes, i), F.try_element_at(morphemes, i + 1)
        verb = F.when(is_verb(m) & (i < n), _mapped(plain_base(m), replacements))
        both = T.let(verb, lambda lemma: F.when(lemma.isNotNull(), T.let(kind(lemma), lambda k: conjugated(lemma, after["surface"], k))))
        taken = T.let(both, lambda b: F.struct(F.concat(s["out"], F.coalesce(b, replaced_token(m, vocabulary, replacements))).alias("out"), b.isNotNull().alias("skip")))
        return F.when(s["skip"], F.struct(s["out"].alias("out"), F.lit(False).alias("skip"))).otherwise(taken)

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("skip"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return T.mend_artifacts(F.aggregate(places, start, step, lambda s: s["out"]))
