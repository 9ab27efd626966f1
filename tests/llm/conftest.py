import pytest

LONG = "many words follow one another here " * 4000

ODD_ROWS = [
    (1, "plain short text", "en", "b", 16),
    (1, "plain short text", "en", "b", 16),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\r\n\x0b\x0c ", "de", None, 7),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, None, "a", len(LONG)),
    (None, "a row without an id", "fr", "c", 19),
    (7, "123 456 éß \U0001f600", "xx", "b", 13),
    (8, "###\x00\x1c###", "en", "\U0001f600", 8),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and long texts, repeated rows, and further columns with names the operators use."""
    rows = spark.createDataFrame(ODD_ROWS, COLUMNS)
    for name in ("size", "row", "shard", "n_words", "score", "_row", "_block", "copies", "component_id"):
        rows = rows.selectExpr("*", f"'mine' as `{name}`")
    return rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
