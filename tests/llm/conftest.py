import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text) or whole rows, with columns that clash with results."""
        full = [r if len(r) == 5 else (*r, "en", "src0", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return docs.selectExpr("*", "'x' AS size", "'y' AS key", "1 AS n_lines", "'z' AS component_id", "2 AS rank", "'w' AS base")
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and very long texts, repeated rows and ties."""
    return [(1, "One line\ntwo lines"), (2, None), (3, ""), (None, "no id here"), (4, LONG), (5, "same text"), (6, "same text"),
            (7, "repeated row"), (7, "repeated row"), (8, " \t\n \r\n"), (9, "Grüße 😀 ñandú\n\n", None, None, None), (10, "1234 !!")]
