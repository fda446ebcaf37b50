"""Column functions against literals and small Python models."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def T():
    return F.col("t")


@pytest.mark.parametrize(
    "text, words, chars",
    [("", 0, 0), ("  \t ", 0, 0), ("a b", 2, 3), (" a b\u001c", 2, 3), ("a😀e\u0301", 1, 4), (" xّ ", 1, 2)],
)
def test_counts(spark, text, words, chars):
    assert one(spark, text, X.word_count(T()), X.char_count(T())) == (words, chars)


def test_white_space_is_pythons(spark):
    rows = [(c, chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(rows, "c int, t string").where(X.strip(T()) == "")
    assert {r["c"] for r in df.collect()} == {c for c, t in rows if t.isspace()}


@pytest.mark.parametrize(
    "text, expected",
    [("", 0.0), ("one two", 0.2), ("a b c word", 0.3), ("a b word word", 4 / 50 * 0.5 + 13 / 500 * 0.5), ("1 ©MSA 2025/2026", 0.046), ("word " * 200, 1.0), (None, 0.0)],
)
def test_direct_confidence(spark, text, expected):
    assert one(spark, text, X.direct_confidence(T()))[0] == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("text, valid, confidence", [("", False, 0.0), ("a b c d", False, 0.2), ("a b c d e", False, 0.3), ("ab cd ef gh ij", False, 0.05 + 0.014), ("word " * 20, True, 0.2 + 0.099)])
def test_page_validation(spark, text, valid, confidence):
    got = one(spark, text, X.validate_page_text(T()))[0]
    assert got["valid"] is valid and got["confidence"] == pytest.approx(confidence)


@pytest.mark.parametrize("text, ratio, three, two", [
    ("", 0.0, "ltr", "ltr"), ("ابت", 1.0, "rtl", "rtl"), ("ابتabcdefg", 0.3, "ltr", "ltr"),
    ("ابتثabcdef", 0.4, "mixed", "rtl"), ("ا" * 7 + "abc", 0.7, "mixed", "rtl"), ("א ב", 1.0, "rtl", "rtl"),
])
def test_direction(spark, text, ratio, three, two):
    r = X.rtl_ratio(T())
    assert one(spark, text, r, X.direction(r), X.direction_two_way(r)) == (pytest.approx(ratio), three, two)


@pytest.mark.parametrize("text, expected", [("é a x", "éa x"), ("t o day", "to day"), ("with each", "witheach"), ("an d", "and"), ("a b", "ab"), ("١ ٢ x", "١٢ x"), ("i s", "is")])
def test_broken_words(spark, text, expected):
    assert one(spark, text, X.fix_broken_words(T()))[0] == expected


@pytest.mark.parametrize("text, expected", [("a | b", "a b"), ("a||b", "ab"), ("x.....", "x..."), ("a-----b", "a--b"), ("a | | b", "a | b"), ("a ~ b ` c", "a b c")])
def test_artifacts(spark, text, expected):
    assert one(spark, text, X.remove_artifacts(T()))[0] == expected


@pytest.mark.parametrize("text, expected", [("a , b", "a, b"), ("end.", "end. "), ("3.14", "3. 14"), ("...", ". . . "), ("  x\t\ny ", "x y"), ("", "")])
def test_spacing(spark, text, expected):
    assert one(spark, text, X.normalize_spacing(T()))[0] == expected


def test_arabic(spark):
    assert one(spark, "آأإـب", X.normalize_arabic(T()))[0] == "اااب"


def test_clean_needs_ratio(spark):
    assert one(spark, "أ", X.clean(T(), F.lit(0.3)), X.clean(T(), F.lit(0.31))) == ("أ", "ا")


def test_preview_and_structured(spark):
    assert one(spark, "word " * 300, F.length(X.preview(T())), X.structured_confidence(T())) == (500, 1.0)
    assert one(spark, "word", X.structured_confidence(T()))[0] == pytest.approx(0.1)


def test_random_word_counts(spark):
    r = random.Random(5)
    rows = [("".join(r.choice("ab \t  　é.") for _ in range(r.randrange(30))),) for _ in range(300)]
    for t, w, c in spark.createDataFrame(rows, "t string").select("t", X.word_count(T()), X.char_count(T())).collect():
        assert (w, c) == (len(t.split()), len(t.strip()))
