import pytest
from pyspark.sql import types as T

#: A table of documents with the hard cases: nulls everywhere, empty and wordless texts, copies, a repeated row, columns with clashing names.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("at", T.StringType()), T.StructField("score", T.StringType())])


def rows():
    base = " ".join(f"word{i} and thing{i % 7}" for i in range(120))
    near = base.replace("word50", "other")
    texts = [(1, base), (2, near), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one"), (9, "Héllo wörld. ¿Qué? 日本語 " * 60), (None, base), (10, "x" * 3000), (11, base + " tail of another kind"), (11, base + " tail of another kind"), (12, ("long " + base + " ") * 40)]
    return [(d, t, None if d == 2 else "en", None if d in (3, None) else f"s{(d or 0) % 2}", None, "k", "c", "a", "s") for d, t in texts]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """About 250 documents of the smallest test table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
