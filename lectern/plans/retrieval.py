"""Retrieval queries: kNN graph, question retrieval, context, sources, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import templates as TPL
from lectern.functions.fixed import NEIGHBOURS
from lectern.operators import prompts as P
from lectern.operators.vectors import attach_metadata, knn_graph, knn_join
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import LECTURES, q, sqdist
from lectern.sources.corpus import index_vectors, lecture_view, question_vectors

K = NEIGHBOURS  # neighbours per query


@register("knn_topk", f"""
SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
       round({sqdist('a.embedding', 'b.embedding')}, 6) AS distance,
       row_number() OVER (PARTITION BY a.vec_id
                          ORDER BY {sqdist('a.embedding', 'b.embedding')}, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
QUALIFY rank <= {K}
""")
def knn_topk(spark, sf):
    t = Tables(spark, sf)
    nn = knn_graph(t.embeddings.select("vec_id", "embedding"), K)
    return nn.select(F.col("vec_id").alias("query_id"), "neighbor_id",
                     F.round("distance", 6).alias("distance"), "rank")


def retrieved(spark, sf):
    """Top-k documents per benchmark question, with lecture metadata."""
    t = Tables(spark, sf)
    questions = question_vectors(t.benchmark, t.embeddings)
    index = index_vectors(t.embeddings, t.documents)
    nn = knn_join(questions, index, K, query_id="item_id", index_id="doc_id")
    meta = lecture_view(t.documents).select("doc_id", "title", "url", "path", "content")
    return attach_metadata(nn, meta).withColumnRenamed("neighbor_id", "doc_id")


RETRIEVED_SQL = f"""
WITH qv AS (SELECT b.item_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
     xv AS (SELECT vec_id AS doc_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
     nn AS (SELECT qv.item_id, xv.doc_id, {sqdist('qv.embedding', 'xv.embedding')} AS dist,
                   row_number() OVER (PARTITION BY qv.item_id ORDER BY {sqdist('qv.embedding', 'xv.embedding')}, xv.doc_id) AS rank
            FROM qv JOIN xv ON TRUE QUALIFY rank <= {K})
SELECT nn.item_id, nn.rank, nn.doc_id, nn.dist, l.title, l.url, l.path, l.content
FROM nn JOIN {LECTURES} l ON l.doc_id = nn.doc_id
"""


@register("retrieve_docs", f"""
SELECT item_id, rank, doc_id, round(dist, 6) AS distance, title, url, path FROM ({RETRIEVED_SQL})
""")
def retrieve_docs(spark, sf):
    r = retrieved(spark, sf)
    return r.select("item_id", "rank", "doc_id", F.round("distance", 6).alias("distance"),
                    "title", "url", "path")


@register("stuff_context", f"""
SELECT item_id, count(*) AS n_docs, string_agg(content, {q(P.CONTEXT_SEPARATOR)} ORDER BY rank) AS context
FROM ({RETRIEVED_SQL}) GROUP BY item_id
""")
def stuff_context(spark, sf):
    return P.stuff_context(retrieved(spark, sf))


@register("source_list", f"""
SELECT item_id, string_agg(printf('[%d] %s (Path=%s)', rank, coalesce(url, 'No URL'), coalesce(path, 'NoPath')),
                           chr(10) ORDER BY rank) AS sources
FROM ({RETRIEVED_SQL}) GROUP BY item_id
""")
def source_list(spark, sf):
    return P.source_list(retrieved(spark, sf))


def _fill_sql(template: str, values: dict[str, str]) -> str:
    from lectern.functions.text import template_parts
    parts = []
    for lit, name in template_parts(template, list(values)):
        if lit:
            parts.append(q(lit))
        if name is not None:
            parts.append(f"coalesce({values[name]}, '')")
    return " || ".join(parts)


@register("prompt_table", f"""
WITH ctx AS (SELECT item_id, string_agg(content, {q(P.CONTEXT_SEPARATOR)} ORDER BY rank) AS context
             FROM ({RETRIEVED_SQL}) GROUP BY item_id)
SELECT b.item_id, {q(TPL.SYSTEM_TEMPLATE)} AS system_prompt,
       {_fill_sql(TPL.HUMAN_TEMPLATE, {'question': 'b.text', 'context': 'ctx.context'})} AS user_prompt
FROM benchmark b LEFT JOIN ctx ON ctx.item_id = b.item_id
""")
def prompt_table(spark, sf):
    t = Tables(spark, sf)
    ctx = P.stuff_context(retrieved(spark, sf))
    return P.prompt_table(t.benchmark.select("item_id", F.col("text").alias("question")), ctx)


@register("retrieval_hit_rate", f"""
SELECT count(*) AS n_questions,
       count_if(doc_id IS NOT NULL) AS n_hits,
       round(count_if(doc_id IS NOT NULL) / count(*), 6) AS hit_rate
FROM benchmark b LEFT JOIN (SELECT item_id, doc_id FROM ({RETRIEVED_SQL}) WHERE doc_id = item_id) r
  ON r.item_id = b.item_id
""")
def retrieval_hit_rate(spark, sf):
    """Share of benchmark questions whose own document (url doc/<item_id>) is retrieved."""
    t = Tables(spark, sf)
    hits = retrieved(spark, sf).where(F.col("doc_id") == F.col("item_id")).select("item_id", "doc_id")
    j = t.benchmark.select("item_id").join(hits, "item_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_questions"),
                 F.count_if(F.col("doc_id").isNotNull()).alias("n_hits"),
                 F.round(F.count_if(F.col("doc_id").isNotNull()) / F.count(F.lit(1)), 6).alias("hit_rate"))
