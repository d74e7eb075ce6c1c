import pytest
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of texts (doc_ids count from 0) or of (doc_id, text) rows."""

    def make(rows, partitions=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(partitions)

    return make
