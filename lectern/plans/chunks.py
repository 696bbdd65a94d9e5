"""The chunk index end to end: chunk -> strip diacritics -> embed in batches -> cells -> retrieve -> answer -> grade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.fixed import NEIGHBOURS, REFUSAL_SENTENCE
from lectern.functions.text import strip_diacritics
from lectern.operators import answer as A
from lectern.operators import cells as X
from lectern.operators import chunk as CH
from lectern.operators import evaluate as E
from lectern.operators import prompts as P
from lectern.operators.embed import embed, term_embedder
from lectern.plans.io import scratch
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import LECTURES, chunks_ctes, diacritics, q, sqdist, term_vectors
from lectern.sources import sinks as K
from lectern.sources.corpus import lecture_view
from lectern.sources.evalset import load_eval_dataset

CELLS = 16


def chunk_vectors(documents: DataFrame) -> DataFrame:
    """(doc_id, title, url, path, chunk_no, text, vec) of all chunks of all ``documents``."""
    lec = lecture_view(documents).select("doc_id", "title", "url", "path", "content")
    chunks = CH.chunk_documents(lec, text="content", keep=["doc_id", "title", "url", "path"])
    rows = chunks.select("doc_id", "title", "url", "path", "chunk_no", strip_diacritics("chunk").alias("text"))
    return embed(rows, term_embedder())


def build(spark, sf) -> str:
    """An index in two writes: documents with even ids, then the others appended to the same cells."""
    path = scratch(spark, "cells")
    docs = Tables(spark, sf).documents  # divided here: a filter on the chunks would be applied behind the embedding of them all
    X.write_index(chunk_vectors(docs.where("doc_id % 2 = 0")), path, batch="first", cells=CELLS)
    X.write_index(chunk_vectors(docs.where("doc_id % 2 <> 0")), path, batch="second")
    return path


def question_rows(t: Tables) -> DataFrame:
    return embed(t.benchmark.select(F.col("item_id").alias("id"), "text"), term_embedder())


INDEX_CTES = f"""
{chunks_ctes()}, entry AS (
  SELECT doc_id, chunk_no, {diacritics('chunk')} AS text FROM chunk
), entry_vec AS (
  SELECT * FROM {term_vectors('entry', 'doc_id, chunk_no', 'text')}
), question_vec AS (
  SELECT * FROM {term_vectors('(SELECT item_id, text FROM benchmark)', 'item_id', 'text')}
), near AS (
  SELECT item_id, doc_id, chunk_no, {sqdist('q.vec', 'e.vec')} AS distance,
         row_number() OVER (PARTITION BY item_id ORDER BY {sqdist('q.vec', 'e.vec')}, doc_id, chunk_no) AS rank
  FROM question_vec q JOIN entry_vec e ON TRUE QUALIFY rank <= {NEIGHBOURS}
), retrieved AS (
  SELECT item_id, rank, doc_id, chunk_no, distance, title, url, path, entry.text
  FROM near JOIN entry USING (doc_id, chunk_no) JOIN {LECTURES} l USING (doc_id)
)"""


@register("index_build", f"""
WITH RECURSIVE {INDEX_CTES}
SELECT doc_id, chunk_no, title, url, path, length(text) AS n_chars, md5(text) AS text_md5,
       len(list_filter(vec, lambda x: x > 0)) AS n_places, round(list_sum(list_transform(vec, lambda x: x * x)), 9) AS norm
FROM entry JOIN entry_vec USING (doc_id, chunk_no) JOIN {LECTURES} l USING (doc_id)
""")
def index_build(spark, sf):
    """Every chunk of every document once, with metadata and vector, as the index holds it after an append."""
    rows = X.read_index(spark, build(spark, sf))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("doc_id", "chunk_no", "title", "url", "path", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
                       F.size(F.filter("vec", lambda x: x > 0)).alias("n_places"), F.round(norm, 9).alias("norm"))


@register("retrieve_chunks", f"""
WITH RECURSIVE {INDEX_CTES}
SELECT item_id, rank, doc_id, chunk_no, round(distance, 6) AS distance, title, url, path, md5(text) AS text_md5 FROM retrieved
""")
def retrieve_chunks(spark, sf):
    """The nearest chunks of each benchmark question: a few cells, then those that may hold nearer ones (exact)."""
    r = X.search(spark, build(spark, sf), question_rows(Tables(spark, sf)), NEIGHBOURS)
    return r.select(F.col("id").alias("item_id"), "rank", "doc_id", "chunk_no", F.round("distance", 6).alias("distance"),
                    "title", "url", "path", F.md5("text").alias("text_md5"))


#: Cells probed by the approximate search: hashed vectors have little structure, and recall is near the share of rows scored.
PROBES = 12


@register("retrieve_chunks_recall", f"""
SELECT count(*) AS n_questions, {NEIGHBOURS} * count(*) AS n_exact, true AS recall_at_least_90, true AS fewer_scored FROM benchmark
""")
def retrieve_chunks_recall(spark, sf):
    """The nearest cells alone against the exact search: recall of its neighbours, and whether fewer rows are scored."""
    t, path = Tables(spark, sf), build(spark, sf)
    qs = question_rows(t)
    exact = X.search(spark, path, qs, NEIGHBOURS).select("id", "distance")
    few = X.search(spark, path, qs, NEIGHBOURS, probes=PROBES).select("id", "rank", "distance")
    # a neighbour at the same distance is as good: copies of a chunk tie
    last = exact.groupBy("id").agg(F.max("distance").alias("last"), F.count(F.lit(1)).alias("n"))
    hit = last.join(few, "id", "left").groupBy("id", "n").agg(F.count_if(F.col("distance") <= F.col("last")).alias("hits"))
    share = X.probed_share(spark, path, qs, PROBES)
    return (hit.agg(F.count(F.lit(1)).alias("n_questions"), F.sum("n").alias("n_exact"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("recall_at_least_90"))
            .withColumn("fewer_scored", F.lit(share < 1)))


# -- evaluation flow --------------------------------------------------------

SET_SQL = "CASE WHEN item_id % 2 = 0 THEN 'Even items' ELSE 'Odd items' END"
FLOW_CTES = f"""
{INDEX_CTES}, told AS (
  SELECT item_id, string_agg(text, {q(P.CONTEXT_SEPARATOR)} ORDER BY rank) AS context,
         list({{'title': title, 'url': url, 'path': path}} ORDER BY rank) AS sources,
         string_agg(printf('[%d] %s (Path=%s)', rank, url, path), chr(10) ORDER BY rank) AS source_list
  FROM retrieved GROUP BY item_id
), asked AS (
  SELECT item_id, {SET_SQL} AS dataset, text AS question, string_split(text, '.')[1] || '.' AS answer, context, sources, source_list,
         regexp_extract(text, '[^\\x20\\x09-\\x0D]+( [^\\x20\\x09-\\x0D]+){{0,3}}') AS probe
  FROM benchmark LEFT JOIN told USING (item_id)
), replied AS (
  SELECT *, coalesce(string_split(substr(held, strpos(held, probe)), '.')[1] || '.', {q(REFUSAL_SENTENCE)}) AS model_answer
  FROM (SELECT *, CASE WHEN probe <> '' THEN list_filter(string_split(coalesce(context, ''), chr(10)), lambda x: contains(x, probe))[1] END AS held FROM asked)
), graded AS (
  SELECT *, CASE WHEN contains(model_answer, {q(REFUSAL_SENTENCE)}) AND trim(answer) <> '' THEN 'INCORRECT'
                 WHEN array_to_string(regexp_extract_all(model_answer, '[^\\x20\\x09-\\x0D]+'), ' ') = array_to_string(regexp_extract_all(answer, '[^\\x20\\x09-\\x0D]+'), ' ') THEN 'CORRECT'
                 ELSE 'INCORRECT' END AS model_score FROM replied
)"""


def flow(spark, sf) -> DataFrame:
    """Questions with context, model_answer, model_sources and model_score: retrieve, answer, grade."""
    t = Tables(spark, sf)
    questions = t.benchmark.select("item_id", F.when(F.col("item_id") % 2 == 0, "Even items").otherwise("Odd items").alias("dataset"),
                                   F.col("text").alias("question"), F.concat(F.split("text", r"\.")[0], F.lit(".")).alias("answer"))
    got = X.search(spark, build(spark, sf), question_rows(t), NEIGHBOURS).withColumnRenamed("id", "item_id").withColumnRenamed("text", "content")
    return A.evaluate(questions, got, A.matching_sentence, A.same_words)


@register("eval_flow", f"""
WITH RECURSIVE {FLOW_CTES}
SELECT item_id, dataset, md5(question) AS question_md5, answer, model_answer, list_transform(sources, lambda s: s.url) AS source_urls,
       md5(source_list) AS source_list_md5, md5(context) AS context_md5, model_score FROM graded
""")
def eval_flow(spark, sf):
    """Every question with its retrieved context, answer, sources and grade."""
    f = flow(spark, sf)
    return f.select("item_id", "dataset", F.md5("question").alias("question_md5"), "answer", "model_answer", F.col("model_sources.url").alias("source_urls"),
                    F.md5("sources").alias("source_list_md5"), F.md5("context").alias("context_md5"), "model_score")


@register("eval_csv_roundtrip", f"""
WITH RECURSIVE {FLOW_CTES}
SELECT dataset, item_id, question, answer, model_answer, model_score, len(sources) AS n_sources,
       sources[1].url AS first_url, sources[1].title AS first_title, sources[len(sources)].path AS last_path FROM graded
""")
def eval_csv_roundtrip(spark, sf):
    """K4 + A2: results per dataset with all columns, model_answer and model_sources included, read back."""
    out = scratch(spark, "flowcsv") + "/eval_results.csv"
    K.write_eval_csv(flow(spark, sf).select("dataset", "item_id", "question", "answer", "model_answer", "model_sources", "model_score"), out)
    back = load_eval_dataset(spark, out).withColumn("s", F.from_json("model_sources", "array<struct<title:string,url:string,path:string>>"))
    return back.select("dataset", F.col("item_id").cast("long").alias("item_id"), "question", "answer", "model_answer", "model_score", F.size("s").alias("n_sources"),
                       F.col("s")[0]["url"].alias("first_url"), F.col("s")[0]["title"].alias("first_title"), F.element_at("s", -1)["path"].alias("last_path"))


@register("eval_flow_summary", f"""
WITH RECURSIVE {FLOW_CTES}
SELECT dataset, count(*) AS total, count_if(model_score = 'CORRECT') AS correct, count_if(model_score = 'INCORRECT') AS incorrect,
       count_if(model_score = 'UNKNOWN') AS unknown, round(count_if(model_score = 'CORRECT') / count(*), 6) AS accuracy FROM graded GROUP BY dataset
""")
def eval_flow_summary(spark, sf):
    """G3 over the flow."""
    return E.dataset_summary(flow(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@register("source_recall", f"""
WITH RECURSIVE {FLOW_CTES}, stored AS (
  SELECT DISTINCT item_id, 'doc/' || doc_id AS url
  FROM asked JOIN documents d ON contains(d.text, string_split(question, chr(10))[1]) AND trim(string_split(question, chr(10))[1]) <> ''
)
SELECT item_id, count(DISTINCT stored.url) AS n_stored, count(DISTINCT r.url) AS n_found
FROM stored LEFT JOIN retrieved r USING (item_id, url) GROUP BY item_id
""")
def source_recall(spark, sf):
    """Of the documents that hold a question's first line (its stored sources), those whose chunks are retrieved."""
    t = Tables(spark, sf)
    got = X.search(spark, build(spark, sf), question_rows(t), NEIGHBOURS).select(F.col("id").alias("item_id"), "url")
    stored = A.holding_documents(t.benchmark.select("item_id", F.split("text", "\n")[0].alias("line")), lecture_view(t.documents), key="item_id")
    return A.source_recall(got, stored, key="item_id")
