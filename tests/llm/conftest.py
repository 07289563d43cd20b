import pytest

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 20_000
CLASHES = "'x' AS score, 1 AS held_out, 2 AS size, 'k' AS key, 3 AS node, 4 AS root, 5 AS part, 6 AS run, 'w' AS words, 7 AS rate, 8 AS copies"


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names used inside."""
    rows = [
        (1, "The same text, twice.", "en", "a"),
        (2, "The same  text,\ttwice.", "en", "a"),
        (3, "The same text, twice.", "en", "b"),
        (3, "The same text, twice.", "en", "b"),
        (4, None, "en", "b"),
        (5, "", "de", "b"),
        (6, " \n\t ", None, "c"),
        (7, "!!! ??? 123", "fr", None),
        (8, LONG, "fr", None),
        (9, "ein kurzer deutscher Satz", "de", ""),
        (None, "a row without an id", "en", "a"),
        (None, None, None, None),
        (10, "Ünïcödé 日本語 text \U0001f600", "en", "a"),
        (10, "another text of the same id", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *CLASHES.split(", "))


@pytest.fixture(scope="session")
def no_documents(edge_documents):
    return edge_documents.limit(0)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (None, 1, 1), (9, None, None), (8, 0, 0), (8, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS n")
