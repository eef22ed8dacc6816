import pytest

EDGES = [
    (900001, None, None, None, None),
    (900002, "", "en", "src1", 0),
    (900003, " \t\n", "en", None, 3),
    (None, "a text that has no id at all but has words enough to be read by every rule of them " * 2, "en", "src2", 1),
    (900004, "one two", "en", "src1", 7),
    (900005, "ONE two", "en", "src1", 7),
    (900006, "éÉ \U0001f600 nul joined |%# \x85x", "fr", "über", 9),
    (900007, "same same same same same same same same same same same same", "en", "src1", 60),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Whole documents of the smallest data, edge rows, one row three times, and clashing columns."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    edges = spark.createDataFrame(EDGES, base.schema)
    extra = "7 as size, 'x' as shard, 1.5 as score, 'y' as row, true as kept, 'z' as node, 3 as label, 'w' as slot"
    return base.union(edges).union(base.limit(1)).union(base.limit(1)).selectExpr("*", *extra.split(", ")).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
