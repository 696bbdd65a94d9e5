"""Queries over input lists: ordinals, bounded section texts, caps, category lines, merged sections, records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import CONTENT_NOT_FOUND, MAX_PER_CATEGORY, MAX_PER_LIST, MAX_TOTAL
from lectern.operators import chat as C
from lectern.operators import evaluate as E
from lectern.operators import lists as L
from lectern.operators import nested as N
from lectern.operators import text as X
from lectern.plans.evaluation import PAIRS_SQL, _report_sql, eval_frame
from lectern.plans.io import scratch
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import LECTURES, q
from lectern.sources import sinks as K
from lectern.sources.corpus import lecture_view

SEGMENT = 20_000  # bytes a segment in the registered queries, so that lists of the small tables have several
LINE = 200_000

NUMBERED = f"""
list_row AS (
  SELECT category, section, min(doc_id) AS f FROM {LECTURES} GROUP BY category, section
), line_row AS (
  SELECT category, row_number() OVER (ORDER BY min(f), category) - 1 AS line_no FROM list_row GROUP BY category
), numbered AS (
  SELECT l.*, line_no, dense_rank() OVER (PARTITION BY l.category ORDER BY f, l.section) - 1 AS list_ord,
         row_number() OVER (PARTITION BY l.category, l.section ORDER BY doc_id) - 1 AS item_no,
         chr(10) || 'Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || content || chr(10) AS piece
  FROM {LECTURES} l JOIN list_row USING (category, section) JOIN line_row USING (category)
)"""


def numbered(t: Tables):
    return L.number_lists(lecture_view(t.documents))


@register("list_ordinals", f"WITH {NUMBERED} SELECT doc_id, line_no, list_ord, item_no FROM numbered")
def list_ordinals(spark, sf):
    """Line, list and item numbers of every lecture, by first appearance in the input."""
    return numbered(Tables(spark, sf)).select("doc_id", "line_no", "list_ord", "item_no")


@register("section_segments", f"""
WITH {NUMBERED}, cut AS (
  SELECT *, coalesce(sum(octet_length(encode(piece))) OVER (PARTITION BY line_no, list_ord ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {SEGMENT} AS seg_no
  FROM numbered
)
SELECT category, section, line_no, list_ord, seg_no::BIGINT AS seg_no, min(item_no) AS first_item, count(*) AS n_lectures,
       md5(string_agg(piece, '' ORDER BY item_no)) AS text_md5 FROM cut GROUP BY category, section, line_no, list_ord, seg_no
""")
def section_segments(spark, sf):
    """G1 by lists of the input, in segments of bounded bytes."""
    s = L.section_segments(numbered(Tables(spark, sf)), limit=SEGMENT)
    return s.select("category", "section", "line_no", "list_ord", "seg_no", "first_item", "n_lectures", F.md5("text").alias("text_md5"))


@register("section_reference_rows", f"WITH {NUMBERED} SELECT DISTINCT line_no, list_ord, title || ' (' || url || ')' AS reference FROM numbered")
def section_reference_rows(spark, sf):
    """G2 by lists of the input, one row a reference."""
    return L.section_references(numbered(Tables(spark, sf)))


@register("list_caps", f"""
WITH {NUMBERED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY list_ord, item_no) AS category_rank FROM numbered WHERE item_no < {MAX_PER_LIST}
  QUALIFY category_rank <= {MAX_PER_CATEGORY}
)
SELECT doc_id, line_no, list_ord, item_no, category_rank FROM ranked ORDER BY line_no, list_ord, item_no LIMIT {MAX_TOTAL}
""")
def list_caps(spark, sf):
    """W2-W4 by lists of the input."""
    c = L.list_caps(numbered(Tables(spark, sf)), per_list=MAX_PER_LIST, per_category=MAX_PER_CATEGORY, total=MAX_TOTAL)
    return c.select("doc_id", "line_no", "list_ord", "item_no", F.col("category_rank").cast("long").alias("category_rank"))


@register("capped_prompts", f"""
WITH {NUMBERED}, kept AS (
  SELECT * FROM numbered WHERE item_no < {MAX_PER_LIST}
  QUALIFY row_number() OVER (PARTITION BY line_no ORDER BY list_ord, item_no) <= {MAX_PER_CATEGORY} ORDER BY line_no, list_ord, item_no LIMIT {MAX_TOTAL}
)
SELECT category, section, count(*) AS n_kept, md5(string_agg(piece, '' ORDER BY item_no)) AS text_md5 FROM kept GROUP BY category, section
""")
def capped_prompts(spark, sf):
    """C4 with the caps first: texts are fetched for the rows that the caps leave, never for whole sections."""
    d = lecture_view(Tables(spark, sf).documents)
    slim = L.number_lists(d.select("doc_id", "category", "section"))
    kept = L.list_caps(slim, per_list=MAX_PER_LIST, per_category=MAX_PER_CATEGORY, total=MAX_TOTAL)  # at most `total` rows
    texts = d.join(F.broadcast(kept.select("doc_id", "item_no")), "doc_id").withColumn("_piece", L.lecture_piece())
    return texts.groupBy("category", "section").agg(F.count(F.lit(1)).alias("n_kept"), F.md5(F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY item_no)")).alias("text_md5"))


@register("nest_category_lines", f"""
WITH {NUMBERED} SELECT title, url, category || ' > ' || section AS path, md5(content) AS content_md5, line_no, list_ord FROM numbered
""")
def nest_category_lines(spark, sf):
    """K3: one line a category (further ones where it is large), written in two appends, read back with all lists in order."""
    out = scratch(spark, "categories")
    lec = lecture_view(Tables(spark, sf).documents).withColumn("lecture_title", F.col("title")).withColumn("lecture_url", F.col("url"))
    lec = lec.withColumn("path", F.concat_ws(" > ", "category", "section"))
    lines = L.category_lines(L.number_lists(lec), limit=LINE)
    keep = F.concat(F.col("line_no").cast("string"), F.lit("\t"), F.col("part_no").cast("string"), F.lit("\t"), F.col("line")).alias("line")
    for odd in (0, 1):
        K.write_lines(lines.where(F.col("line_no") % 2 == odd).select(keep), out, mode="append")
    back = spark.read.text(out).select(F.split("value", "\t", 3).alias("v")).select(F.col("v")[0].cast("long").alias("line_no"), F.col("v")[1].cast("long").alias("part_no"), F.col("v")[2].alias("line"))
    docs = N.flatten_lectures_ordered(back, keys=["line_no", "part_no"]).where("status = 'ok'")
    docs = docs.select("line_no", "part_no", "list_ord", "path", "title", "url", F.md5("content").alias("content_md5"))
    lists = docs.groupBy("line_no", "path").agg(F.min(F.struct("part_no", "list_ord")).alias("at"))
    from pyspark.sql import Window
    lists = lists.withColumn("list_ord", (F.row_number().over(Window.partitionBy("line_no").orderBy("at")) - 1).cast("long")).drop("at")
    return docs.drop("list_ord").join(lists, ["line_no", "path"]).select("title", "url", "path", "content_md5", "line_no", "list_ord")


@register("section_merge_lists", f"""
WITH deep AS (
  SELECT *, category || ' > ' || CASE WHEN doc_id % 2 = 0 THEN section ELSE 'deep > ' || section END AS p FROM {LECTURES}
), cut AS (
  SELECT *, coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY category, section ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {SEGMENT} AS seg_no FROM deep
)
SELECT category, section, seg_no::BIGINT AS seg_no, count(*) AS n_lectures, count(DISTINCT p) AS n_paths,
       list(title ORDER BY doc_id) AS titles, list(url ORDER BY doc_id) AS urls FROM cut GROUP BY category, section, seg_no
""")
def section_merge_lists(spark, sf):
    """Sections of one name at two depths, merged into ordered lists."""
    lec = lecture_view(Tables(spark, sf).documents)
    sub = F.when(F.col("doc_id") % 2 == 0, F.col("section")).otherwise(F.concat(F.lit("deep > "), "section"))
    return L.merged_sections(lec.withColumn("path", F.concat_ws(" > ", "category", sub)), limit=SEGMENT)


@register("drop_placeholders", f"""
SELECT doc_id, md5(content) AS content_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN {q(CONTENT_NOT_FOUND)} ELSE content END AS content FROM {LECTURES})
WHERE content <> {q(CONTENT_NOT_FOUND)}
""")
def drop_placeholders(spark, sf):
    """Lectures whose content is the not-found text stay out of the index."""
    lec = lecture_view(Tables(spark, sf).documents)
    lec = lec.withColumn("content", F.when(F.col("doc_id") % 6 == 1, F.lit(CONTENT_NOT_FOUND)).otherwise(F.col("content")))
    return N.drop_placeholders(lec, CONTENT_NOT_FOUND).select("doc_id", F.md5("content").alias("content_md5"))


@register("report_file", f"SELECT string_agg(report, chr(10) || chr(10) ORDER BY dataset) || chr(10) AS report FROM ({_report_sql()})")
def report_file(spark, sf):
    """K5: the combined report written as one text file and read back whole."""
    out = scratch(spark, "report")
    K.write_text_report(E.combined_report(E.dataset_report(eval_frame(Tables(spark, sf)))), out)
    return spark.read.text(out, wholetext=True).select(F.col("value").alias("report"))


@register("completion_records", f"""
SELECT 'ROOT > conv' AS category_or_path, 'General' AS question_type, question, md5(answer) AS answer_md5,
       CASE WHEN conv_id % 4 = 0 THEN 'N/A' ELSE CAST(turn AS VARCHAR) END AS confidence,
       CASE conv_id % 3 WHEN 0 THEN ['a', 'doc/' || turn] WHEN 1 THEN ['one'] ELSE [] END AS references_from_llm,
       ['conv/' || conv_id] AS source_lectures, ceil(length(question) / 4)::BIGINT AS input_tokens, ceil(length(raw) / 4)::BIGINT AS output_tokens
FROM (SELECT *, '```json' || to_json(question) || to_json(answer) AS unused,
             '{{"question":' || to_json(question) || ',"answer":' || to_json(answer) ||
             CASE WHEN conv_id % 4 = 0 THEN '' ELSE ',"confidence":' || turn END ||
             CASE conv_id % 3 WHEN 0 THEN ',"references":["a","doc/' || turn || '"]' WHEN 1 THEN ',"references":"one"' ELSE '' END || '}}' AS raw
      FROM {PAIRS_SQL})
WHERE length(answer) >= 40
""")
def completion_records(spark, sf):
    """Completions with references and usage become QA records."""
    p = C.chat_pairs(Tables(spark, sf).conversations)
    part = lambda c: F.get(F.split(F.to_json(F.struct(F.col(c).alias("x"))), '^\\{"x":'), 1)
    text = lambda c: F.substring(part(c), F.lit(1), F.length(part(c)) - 1)
    refs = (F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(',"references":["a","doc/'), F.col("turn").cast("string"), F.lit('"]')))
            .when(F.col("conv_id") % 3 == 1, F.lit(',"references":"one"')).otherwise(F.lit("")))
    raw = F.concat(F.lit('{"question":'), text("question"), F.lit(',"answer":'), text("answer"),
                   F.when(F.col("conv_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"confidence":'), F.col("turn").cast("string"))), refs, F.lit("}"))
    asked = p.withColumn("raw", raw).select("conv_id", "turn", "raw", F.ceil(F.length("question") / 4).cast("long").alias("input_tokens"),
                                            F.ceil(F.length(raw) / 4).cast("long").alias("output_tokens"))
    r = X.completion_records(X.parse_completion(asked), category=F.lit("ROOT > conv"), question_type=F.lit("General"),
                             sources=F.array(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))))
    return r.select("category_or_path", "question_type", "question", F.md5("answer").alias("answer_md5"), "confidence", "references_from_llm", "source_lectures",
                    F.col("token_usage.input_tokens").alias("input_tokens"), F.col("token_usage.output_tokens").alias("output_tokens"))
