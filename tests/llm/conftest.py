import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept int, key int, row int, size int"

LONG = " ".join(f"word{i % 7}{i}" for i in range(20_000))
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", "de", None),
    (4, "Hello big wide world", "en", "b"),
    (4, "Hello big wide world", "en", "b"),
    (5, "hello BIG  wide\nworld", None, "b"),
    (6, "Hello  big wide world", "xx", None),
    (None, "a text without an id", "en", "c"),
    (7, LONG, "fr", "c"),
    (8, LONG + " ", None, None),
    (9, "é" * 5000, "fr", ""),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named as the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2, 3, 4) for r in EDGES], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, small):
    """(doc_id, text, lang, source) of the given documents, as tuples."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [tuple(r) for r in rows]
