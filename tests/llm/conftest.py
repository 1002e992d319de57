import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from texts or from (doc_id, text) pairs; columns with clashing names may follow."""

    def make(rows, extra=()):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        schema = T.StructType([*DOCS.fields, *(T.StructField(n, T.StringType()) for n in extra)])
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *("x" for _ in extra)) for i, t in rows], schema)

    return make
