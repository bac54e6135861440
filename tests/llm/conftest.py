import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, salt int, pos int"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2) for i, t in rows], SCHEMA)

    return make
