import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash."""
    para = "the quick brown fox jumps over the lazy dog while ten grey wolves watch from a far hill and say nothing at all "
    rows = [
        (1, para * 3, "en", "a"), (2, para * 3, "en", "a"), (3, "x " + para * 3, "en", "b"), (4, None, None, None), (5, "", "en", "a"), (None, "text of a row without id, " + para, "en", "c"),
        (6, "same line that is long\nother\n" + para, "en", "a"), (7, "same line that is LONG \nmore lines here\n" + para[:60], "fr", "b"), (7, "same line that is LONG \nmore lines here\n" + para[:60], "fr", "b"), (7, "a different text with the same id", "fr", "b"),
        (8, "ab" * 40_000, "en", "a"), (9, "é ü 日本語 \U0001f600 " * 30, "ja", "b"), (10, " \t\n \n", "en", None), (11, "one", "en", "a"), (12, "word " * 5000, "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", "'mine' as n_words", "1 as digest", "2 as doc", "3 as kept")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
