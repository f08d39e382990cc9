import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts: ids from 0, or (id, text) pairs."""

    def make(texts, extra=""):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", None, len(t or ""), *["x"] * bool(extra)) for i, t in rows], SCHEMA + extra)

    return make
