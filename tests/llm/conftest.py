import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table from (doc_id, text[, lang[, source]]) rows."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def clash(docs):
    """The same table with extra columns whose names clash with those the operators use inside."""
    def make(rows):
        from pyspark.sql import functions as F
        d = docs(rows)
        for c in ("start", "size", "key", "range", "node", "digest", "row", "u", "v", "part", "pass", "src", "target", "__x", "gone", "pii", "h1", "at", "n", "sig", "score", "lang_pred", "rank", "words"):
            d = d.withColumn(c, F.lit(f"own {c}"))
        return d
    return make


ODD = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, "one", "en", None), (3, "one", "en", None), (3, "one", "en", None),
    (None, "no id here", "de", "b"), (5, "   \n\t ", None, "b"), (6, "x " * 40000, "fr", "c"), (7, "𝄞é ß " * 50, None, None),
    (8, "1234567890 !!! ???", "es", "a"), (9, "a" * 70000, "en", "c"),
]
