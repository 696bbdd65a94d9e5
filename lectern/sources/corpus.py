"""Views of the driver tables in the reference's data model.

``documents`` stands in for lectures: ``lang`` is the category, ``source`` the
section, ``doc_id`` the list order.  Title and URL are derived from the id;
the stored lecture path is ``category > section``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lecture_view(documents: DataFrame) -> DataFrame:
    """(doc_id, category, section, title, url, path, content) - one lecture per document."""
    return documents.select(
        "doc_id",
        F.col("lang").alias("category"),
        F.col("source").alias("section"),
        F.concat(F.col("source"), F.lit(" #"), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat_ws(" > ", F.lit("ROOT"), F.col("lang"), F.col("source")).alias("path"),
        F.col("text").alias("content"),
    )


def question_vectors(benchmark: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Benchmark questions with their embedding (``vec_id == item_id``)."""
    return benchmark.join(embeddings.select(F.col("vec_id").alias("item_id"), "embedding"),
                          "item_id", "inner").select("item_id", F.col("text").alias("question"), "embedding")


def index_vectors(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors that have a document (semi-join before the top-k, so k rows always exist)."""
    return (embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
            .join(documents.select("doc_id"), "doc_id", "left_semi"))
