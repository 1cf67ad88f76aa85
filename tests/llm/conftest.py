import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _b string, _h string, fp string, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [
        (1, "one two three four five six", "en", "a"),
        (1, "one two three four five six", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (None, "a text without id but with words", "en", "b"),
        (5, long, "de", "a"),
        (6, long + " tail", "de", "a"),
        (7, " \t\n ", "fr", ""),
        (8, "x" * 50_000, None, "b"),
        (9, "ÀÉ ñandú\n\nzwei\nzeile", "es", "a"),
        (10, "one two three four five six", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "b", "h", "f", "i") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
