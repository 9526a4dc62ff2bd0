import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, digest string, rep int, size string, key string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns named like inner ones."""
    long_text = "the cat sat on the mat and looked at the dog " * 4000
    rows = [(1, "Der Hund und die Katze schlafen", "de", "b"), (2, None, "en", None), (3, "", None, "a"), (4, "   \n\t ", "en", "a"),
            (5, long_text, "en", "a"), (6, "THE Cat sat on the mat", "en", "a"), (7, "the cat SAT on the mat", "en", None),
            (8, "12345 678 90", None, "b"), (9, "x", "fr", "b"), (9, "x", "fr", "b"), (None, "no id here at all", "en", "a"),
            (None, None, None, None), (10, "word" * 5000, "en", "c"), (11, "café über señor 日本語 текст", "es", "c")]
    return spark.createDataFrame([(i, t, g, s, None, "d", "g", 7, "s", None) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
