"""Text scoring and cleaning as Column expressions, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that Java and Python would otherwise read differently.
WS = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
RTL_OUTSIDE, RTL_INSIDE = r"[^\x{590}-\x{6ff}]", r"[\x{590}-\x{6ff}]"
# The rules of text cleaning, in their order.
SPLIT_PAIR = rf"(?<!{WORD})({WORD}){WS}+({WORD})(?!{WORD})"
REJOIN = (("th e", "the"), ("an d", "and"), ("i s", "is"))
ARTIFACTS = ((rf"{WS}+[|~`]{WS}+", " "), (r"[|~`]{2,}", ""), (r"\.{3,}", "..."), (r"-{3,}", "--"))
ALEF_FORMS, ALEF, TATWEEL = "آأإ", "ا", "ـ"


#: The characters of WS, for trimming without a pattern.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body mentions it.

    A lambda variable is never inlined by the optimiser, unlike a column of a lower projection.
    """
    return F.transform(F.array(value), body)[0]


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(BLANKS))


def char_count(t: Column) -> Column:
    return F.length(strip(t))


def words(t: Column) -> Column:
    """array<string> of what stands between white space; null for null."""
    return F.filter(F.split(t, rf"{WS}+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    """Words between white space, 0 for null and blank."""
    return F.coalesce(F.size(words(t)), F.lit(0))


def single_char_words(t: Column) -> Column:
    return F.size(F.filter(words(t), lambda w: F.length(w) == 1))


def measures(t: Column) -> Column:
    """struct<words, singles, chars> of a text, which is split once."""
    counts = let(words(t), lambda w: F.struct(F.size(w).alias("words"), F.size(F.filter(w, lambda x: F.length(x) == 1)).alias("singles")))
    return let(counts, lambda c: F.struct(F.coalesce(c["words"], F.lit(0)).alias("words"), F.coalesce(c["singles"], F.lit(0)).alias("singles"), char_count(t).alias("chars")))


def _length_score(words: Column, chars: Column) -> Column:
    return F.least(F.lit(1.0), words / F.lit(50.0) * F.lit(0.5) + chars / F.lit(500.0) * F.lit(0.5))


def _confidence(m: Column, few: int) -> Column:
    score = F.when(m["words"] < few, F.lit(0.2)).when(m["singles"] / m["words"] > 0.5, F.lit(0.3)).otherwise(_length_score(m["words"], m["chars"]))
    return F.when(m["words"] == 0, F.lit(0.0)).otherwise(score)


def measured_confidence(m: Column) -> Column:
    """0 for blank, 0.2 below three words, 0.3 for mostly single characters, else by length; m are a text's measures."""
    return _confidence(m, 3)


def direct_confidence(t: Column) -> Column:
    return let(measures(t), measured_confidence)


def validate_page_text(t: Column, threshold: float = 0.1) -> Column:
    """struct<valid, confidence> of a whole page's text."""

    def judged(m: Column) -> Column:
        weak = (m["words"] < 5) | (m["singles"] / m["words"] > 0.5)
        score = _confidence(m, 5)
        return F.struct((~weak & (score > threshold)).alias("valid"), score.alias("confidence"))

    return let(measures(t), judged)


def structured_confidence(t: Column) -> Column:
    return F.least(F.lit(1.0), word_count(t) / F.lit(10.0))


def rtl_ratio(t: Column) -> Column:
    """Characters U+0590 to U+06FF per character that is not white space; 0 for blank.

    Most texts have none, which one search tells.
    """
    rtl, all_ = F.length(F.regexp_replace(t, RTL_OUTSIDE, "")), F.length(F.regexp_replace(t, WS, ""))
    return F.when(t.rlike(RTL_INSIDE), F.try_divide(rtl, all_)).otherwise(F.lit(0.0))


def direction(ratio: Column) -> Column:
    return F.when(ratio > 0.7, "rtl").when(ratio > 0.3, "mixed").otherwise("ltr")


def direction_two_way(ratio: Column) -> Column:
    return F.when(ratio > 0.3, "rtl").otherwise("ltr")


def block_text(lines: Column) -> Column:
    """All spans of all lines, joined by one space."""
    return strip(F.array_join(F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["text"]))), " "))


def normalize_arabic(t: Column) -> Column:
    return F.translate(t, ALEF_FORMS + TATWEEL, ALEF * 3)


def fix_broken_words(t: Column) -> Column:
    t = F.regexp_replace(t, SPLIT_PAIR, "$1$2")
    for broken, whole in REJOIN:
        t = F.replace(t, F.lit(broken), F.lit(whole))
    return t


def remove_artifacts(t: Column) -> Column:
    for pattern, into in ARTIFACTS:
        t = F.regexp_replace(t, pattern, into)
    return t


def normalize_spacing(t: Column) -> Column:
    """One space between words, none before a mark and exactly one after it, at the end too."""
    t = strip(F.regexp_replace(t, rf"{WS}+", " "))
    return F.regexp_replace(F.regexp_replace(t, rf"{WS}+([.,!?;:])", "$1"), rf"([.,!?;:]){WS}*", "$1 ")


def clean(t: Column, ratio: Column) -> Column:
    """The whole cleaning chain; Arabic forms only where the block reads right to left."""
    t = F.when(ratio > 0.3, normalize_arabic(t)).otherwise(t)
    return normalize_spacing(remove_artifacts(fix_broken_words(t)))


def preview(t: Column, chars: int = 500) -> Column:
    return F.substring(t, 1, chars)
