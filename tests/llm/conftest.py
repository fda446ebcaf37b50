import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    prose = " ".join(f"word{i % 97} of the {i % 89}" for i in range(400))
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, None, "fr", "b"), (4, "", None, None), (5, "   \n\t ", "de", "b"), (None, "some text here", "en", "a"),
        (6, "Einige Wörter und der die das " * 30, "de", None), (7, "x" * 40_000, "en", "a"), (8, "12345 !!! ###", None, "c"), (9, prose + " one more tail", "en", "c"),
        (10, "le la les des mots " * 5000, "fr", "a"), (11, "short\ntext", "en", "b"),
    ]
    full = [(i, t, lang, s, len(t) if t else None, f"k{i}", 7, "h", 1.5, "p") for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string, n int, hash string, score double, pos string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
