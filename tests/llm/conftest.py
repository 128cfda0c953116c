import pytest

LONG = "Long words go on and on, ünd weiter. " * 6000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with names the operators use themselves."""
    rows = [
        (None, None, None, "a", None, 1, "k"), (None, "a text without a name, twice", "en", None, 28, 2, "k"), (1, "", "en", "a", 0, 3, None), (2, None, None, "a", None, 4, "k"),
        (3, "one two three", "en", "a", 13, 5, "k"), (3, "one two three", "en", "a", 13, 5, "k"), (4, LONG, "de", "a", len(LONG), 6, "k"), (5, LONG, "de", "b", len(LONG), 7, "k"),
        (6, "123 456 !!!", None, "b", 11, 8, "k"), (7, "one two three", "en", "b", 13, 9, "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, set_key long, key string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
