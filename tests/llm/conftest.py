import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id, text, lang, source and n_chars from (id, text) pairs, with an extra column of a clashing name."""

    def build(rows, extra="key"):
        full = [(i, t, "en", "src1", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")

    return build
