import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of the operators."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, "one two three four five six seven eight nine ten\nalpha beta", "en", "a", 1),
        (1, "one two three four five six seven eight nine ten\nalpha beta", "en", "a", 1),
        (2, None, None, None, 2),
        (3, "", "en", "b", 3),
        (None, "text of a row without an id", "en", "b", 4),
        (4, "   \n\n  \t", "en", "b", 5),
        (5, long, "en", "b", 6),
        (6, "!!! ... 123", None, "b", 7),
        (6, "another text of the same id", "fr", "b", 8),
        (7, "Ça été où naïve \U0001f600 İstanbul", "fr", None, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
