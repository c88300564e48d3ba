import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents of ``(doc_id, text)`` pairs, with extra columns whose names
    operators use themselves."""

    def make(rows, **extra):
        schema = T.StructType([*DOCS.fields, *[T.StructField(n, T.StringType()) for n in extra]])
        return spark.createDataFrame([(i, t, None, "s", None, *extra.values()) for i, t in rows], schema)

    return make


#: Names that operators use for columns of their own.
CLASH = {"id": "x", "n": "x", "key": "x", "token": "x", "doc": "x", "run": "x", "kept": "x", "length": "x", "label": "x", "score": "x"}


@pytest.fixture
def clash():
    return CLASH
