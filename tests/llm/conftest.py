import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, source]) as a documents table, with an extra column whose name clashes with those of operators."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, "x") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", size string").repartition(2)

    return make
