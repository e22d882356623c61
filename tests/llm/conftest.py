import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text, lang, source) as a table of documents, dealt over a few partitions."""

    def make(rows):
        full = [(*(tuple(r) + (None,) * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
