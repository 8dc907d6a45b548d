import pytest

LONG = "lorem ipsum dolor " * 20000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "b"),
    (2, None, "a"),
    (3, "", None),
    (4, "   \n\t ", "a"),
    (5, LONG, "b"),
    (6, "The quick brown fox jumps over the lazy dog again and again.", "b"),
    (7, "Ünïcödé 世界 \x00 text ▁ with\u00a0odd  blanks <|endoftext|>", "c"),
    (8, "short", "a"),
    (8, "short", "a"),
    (None, "a text without an id", "a"),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "en", s, len(t or ""), "x", 1, "k", 2.0, 3) for i, t, s in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, part int, key string, size double, rank int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
