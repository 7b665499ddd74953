import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "lorem ipsum dolor sit amet " * 8000
#: Nulls in every column, empty and very long texts, exact and near copies, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0),
    (None, "a text without an id that is long enough to matter", "en", "a", 5), (4, "  \t\n ", "fr", "b", 4), (5, LONG, "la", "a", 9), (6, LONG, "la", "c", 9),
    (7, "le chat noir dort sur la chaise près du feu", "fr", "b", 3), (7, "le chat noir dort sur la chaise près du feu", "fr", "b", 3),
    (8, "word", "en", None, 4), (9, "The QUICK brown fox jumps over the lazy dog near the river bank today", "en", "a", 1), (10, "😀 été Ünïcode ✓", None, "c", 2),
]


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as a Parquet table and reads it back, as the operators' inputs are table scans."""
    count = [0]

    def write(rows, schema):
        count[0] += 1
        path = str(tmp_path_factory.mktemp("t") / f"t{count[0]}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(table):
    return table([], DOCS)


@pytest.fixture(scope="session")
def clashing(table):
    """The odd documents with columns that are named like the operators' own."""
    names = ["size", "score", "row", "fp", "component", "shard", "slot", "place", "copies", "keep", "host", "path", "p", "key", "words", "target"]
    schema = T.StructType(DOCS.fields + [T.StructField(n, T.StringType()) for n in names])
    return table([r + ("x",) * len(names) for r in ODD], schema)


@pytest.fixture(scope="session")
def labels(table):
    return table([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(table):
    return table([], "doc_id long, quality int, toxic int")
