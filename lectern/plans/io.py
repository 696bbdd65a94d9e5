"""Source/sink round trips: each query writes with a sink and reads the result
back with the matching source, under the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import chat as C
from lectern.operators import text as X
from lectern.plans.evaluation import CATEGORIES, EVAL_SQL, PAIRS_SQL, eval_frame
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import LECTURES
from lectern.session import ensure_checkpoint_dir
from lectern.sources import sinks as K
from lectern.sources.corpus import lecture_view
from lectern.sources.evalset import QA_SCHEMA, load_eval_dataset, load_eval_datasets


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex[:12]}"


def qa_frame(t: Tables):
    p = X.drop_blank_qa(C.chat_pairs(t.conversations))
    return X.qa_records(p, category=F.concat(F.lit("conv/"), F.col("conv_id").cast("string")),
                        source=F.format_string("conv/%d#%d", F.col("conv_id"), F.col("turn")))


QA_SQL = f"""
SELECT 'conv/' || conv_id AS category_or_path, question, answer FROM {PAIRS_SQL}
"""


@register("qa_sink_roundtrip", QA_SQL)
def qa_sink_roundtrip(spark, sf):
    """K1 + A2: write QA JSONL (overwrite), read it back as an evaluation dataset."""
    path = scratch(spark, "qa") + "/part.jsonl"
    K.write_qa_jsonl(qa_frame(Tables(spark, sf)), path)
    back = load_eval_dataset(spark, path, QA_SCHEMA)
    return back.select("category_or_path", "question", "answer")


@register("qa_sink_append", f"""
SELECT category_or_path, 2 * count(*) AS n FROM ({QA_SQL}) GROUP BY 1
""")
def qa_sink_append(spark, sf):
    """K2: two appends of the same records -> every record twice."""
    path = scratch(spark, "qa-append") + "/part.jsonl"
    recs = qa_frame(Tables(spark, sf))
    K.write_qa_jsonl(recs, path, mode="append")
    K.write_qa_jsonl(recs, path, mode="append")
    back = spark.read.schema(QA_SCHEMA).json(path)
    return back.groupBy("category_or_path").agg(F.count(F.lit(1)).alias("n"))


@register("eval_scan_roundtrip", f"""
SELECT dataset, row_id, question, answer, model_score FROM {EVAL_SQL}
""")
def eval_scan_roundtrip(spark, sf):
    """K4 + A2: per-dataset CSVs with quoted multi-line text, read back by extension."""
    out = scratch(spark, "evalcsv") + "/eval_results.csv"
    ev = eval_frame(Tables(spark, sf)).select("dataset", "row_id", "question", "answer", "model_score")
    K.write_eval_csv(ev, out)
    back = load_eval_dataset(spark, out)
    return back.select("dataset", F.col("row_id").cast("long").alias("row_id"), "question", "answer",
                       "model_score")


@register("eval_union", f"""
SELECT dataset, count(*) AS n, count(DISTINCT category_or_path) AS n_categories FROM (
  SELECT CASE WHEN turn % 2 = 0 THEN 'Even turns' ELSE 'Odd turns' END AS dataset, 'conv/' || conv_id AS category_or_path
  FROM {PAIRS_SQL}) GROUP BY dataset
""")
def eval_union(spark, sf):
    """A3: two JSONL datasets (records split by turn parity) loaded with labels and unioned."""
    base = scratch(spark, "union")
    recs = qa_frame(Tables(spark, sf))
    turn = F.regexp_extract(F.element_at("source_lectures", 1), r"#(\d+)$", 1).cast("long")
    K.write_qa_jsonl(recs.where(turn % 2 == 0), base + "/even.jsonl")
    K.write_qa_jsonl(recs.where(turn % 2 == 1), base + "/odd.jsonl")
    u = load_eval_datasets(spark, [("Even turns", base + "/even.jsonl"), ("Odd turns", base + "/odd.jsonl")],
                           QA_SCHEMA)
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                    F.count_distinct("category_or_path").alias("n_categories"))


@register("category_metrics_json", f"""
SELECT '{{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}}' AS metrics
FROM (SELECT c.lang, coalesce(n, 0) AS n
      FROM (VALUES {", ".join(f"('{c}')" for c in CATEGORIES)}) c(lang)
      LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d ON d.lang = c.lang)
""")
def category_metrics_json(spark, sf):
    """K6: category counts (zeros kept) as one JSON object."""
    from lectern.plans.evaluation import category_counts
    return K.metrics_json(category_counts(spark, sf).withColumnRenamed("lang", "category"))


@register("index_overwrite_append", f"""
SELECT doc_id, 2 AS copies FROM {LECTURES}
""")
def index_overwrite_append(spark, sf):
    """K7: overwrite twice (no growth), then append once (every row twice)."""
    path = scratch(spark, "index")
    idx = lecture_view(Tables(spark, sf).documents).select("doc_id", "title", "url", "path", "content")
    K.write_index(idx, path, overwrite=True)
    K.write_index(idx, path, overwrite=True)
    K.write_index(idx, path, overwrite=False)
    back = spark.read.parquet(path)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@register("doc_export", f"""
SELECT url, title, path, md5(content) AS content_md5 FROM {LECTURES}
""")
def doc_export(spark, sf):
    """K8: one JSON object per document chunk, read back and parsed."""
    path = scratch(spark, "export")
    lec = lecture_view(Tables(spark, sf).documents).withColumnRenamed("content", "page_content")
    K.write_lines(K.document_json(lec), path, mode="overwrite")
    back = spark.read.text(path).select(F.parse_json("value").alias("v"))
    return back.select(F.variant_get("v", "$.metadata.url", "string").alias("url"),
                       F.variant_get("v", "$.metadata.title", "string").alias("title"),
                       F.variant_get("v", "$.metadata.path", "string").alias("path"),
                       F.md5(F.variant_get("v", "$.page_content", "string")).alias("content_md5"))
