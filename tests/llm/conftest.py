import pytest
from pyspark.sql import types as T

LONG = "word " * 60_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "src0", 59),
    (2, "The quick  brown fox jumps over\tthe lazy dog again and again", "en", "src0", 60),
    (2, "The quick  brown fox jumps over\tthe lazy dog again and again", "en", "src0", 60),
    (3, None, None, None, None), (4, "", "en", "src1", 0), (5, " \n\t ", "de", "src1", 4),
    (6, LONG, "en", "src2", len(LONG)), (7, "x", "fr", None, 1), (None, "no id é 漢字 here", "fr", "src0", 16),
    (8, "Straße über éclair ñandú ÀÉ", "de", "src9", 27), (9, "one two", "en", "src3", 7),
]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()))])
#: Names that operators use for their own columns.
CLASH = ["shard", "slot", "key", "run", "id", "kept", "size", "row", "cell", "place", "score", "n", "rep", "seq",
         "normal", "component_id", "sha_of_text", "best", "head", "comp", "length", "piece", "spans"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F
    return edge.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
