import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, node string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text), with columns whose names clash with the operators' own."""

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 2}", None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA)

    return docs
