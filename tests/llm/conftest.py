import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n", "en", "s", 3),
        (4, "the cat and the dog " * 15000, "en", "s", 1),
        (5, "word", "de", None, 4),
        (5, "word", "de", None, 4),
        (None, "no id here", None, "t", 1),
        (None, "no id here", None, "t", 1),
        (6, "\x00nul é \U0001f600 " * 3, "fr", "t", 9),
    ]
    more = ", _words string, _n_words int, n_words int, size int, kept int, a int, part int, k int, bucket int, _judged int, w int"
    return spark.createDataFrame([(*r, *["x"], *[0] * 10) for r in rows], DOCS + more)
