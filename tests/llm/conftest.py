import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """documents rows from (doc_id, text[, source]), with an extra column whose name clashes with internal ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7) for r in rows]
        return spark.createDataFrame(full, DOCS + ", size int").repartition(3)

    return make
