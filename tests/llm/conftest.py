import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with a clashing extra column."""

    def make(rows, extra="size"):
        data = [(i, t, "en", f"src{n % 3}" if n % 4 else None, len(t) if t is not None else None, n) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra} long")

    return make
