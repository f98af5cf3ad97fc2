import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of documents, with an extra column that clashes with names used inside."""

    def make(rows, schema="doc_id long, text string, id string, v int"):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)

    return make
