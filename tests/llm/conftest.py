import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a table of documents from (doc_id, text) rows, with columns whose names the operators use themselves."""

    def make(rows, source="s"):
        df = spark.createDataFrame([(i, t, "en", source, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        clash = ["doc", "row", "key", "site", "at", "line", "gone", "n_lines", "score", "shingle", "anchor", "start", "size", "u", "v", "a.b"]
        return df.select("*", *(F.lit(7).alias(c) for c in clash))

    return make


LONG = "word salad " * 60_000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "x"), (6, "x"), (None, "lost row"), (None, None), (9, "é" * 300), (10, "same text here " * 20), (11, "same text here " * 20)]
