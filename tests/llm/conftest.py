import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(texts, start=0):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, start)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names the operators use themselves."""
    prose = "The quick brown fox jumps over the lazy dog while seven wizards brew a potent potion. " * 3
    rows = [(1, prose, 1), (1, prose, 1), (2, None, 2), (3, "", 3), (None, prose + " more", 4), (4, " \n\t ", 5), (5, "word " * 30_000, 6), (6, prose + "\n" + prose.upper(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    for name in ("node", "key", "length", "start", "row", "words", "h1", "first", "_gone", "kept", "score"):
        df = df.withColumn(name, df["n"])
    return df
