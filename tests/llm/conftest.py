import pytest

from realcurve.llm.common import landing

WORD_SPACE = r"[\x20\x09-\x0D]+"


@pytest.fixture
def land(spark):
    return landing(spark)


@pytest.fixture
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, repeated rows, ties and clashing extra columns."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "s1"),
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "s1"),
        (2, None, None, None, None, None),
        (3, "", "en", "b", 0, "x"),
        (4, " \t\n", "en", "b", 3, "x"),
        (5, long, "en", "a", len(long), "x"),
        (6, "The quick brown fox jumps over the lazy dog again and again now", "en", "b", 5, "x"),
        (None, "no id at all here but words enough", "en", None, 5, "x"),
        (8, "one two", "de", "é", 7, "x"),
        (9, "ONE TWO", "de", "é", 7, "x"),
        (7, "émoji 😀 und ß, non breaking space", "de", "a", 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
