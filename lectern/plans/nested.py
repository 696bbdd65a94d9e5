"""Nested JSON queries: line scan, nesting round trip, gates, first key, allow-list, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import nested as N
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import LECTURES, q, strip
from lectern.sources.corpus import lecture_view

LINES_PER_LIST = 1000  # lectures per nested line (list unit)


def _event_lines(t: Tables):
    """JSON lines from ``events.props`` with blank, padded and broken lines by a fixed rule."""
    e = t.events
    m = F.col("event_id") % 10
    line = (F.when(m == 3, F.lit(""))
            .when(m == 7, F.concat(F.lit("not json "), F.col("props")))
            .when(m == 5, F.concat(F.lit("  "), F.col("props"), F.lit("\t")))
            .otherwise(F.col("props")))
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"), "event_type")


EVENT_LINES_SQL = """
(SELECT event_id AS line_no, event_type,
        CASE event_id % 10 WHEN 3 THEN '' WHEN 7 THEN 'not json ' || props
             WHEN 5 THEN ' ' || chr(160) || props || chr(9) ELSE props END AS line FROM events)
"""


@register("jsonl_valid_lines", f"""
SELECT line_no, status, CASE WHEN status = 'valid' THEN TRY_CAST(s AS JSON) ->> '$.k' END AS k
FROM (SELECT line_no, {strip('line')} AS s,
             CASE WHEN {strip('line')} = '' THEN 'blank' WHEN json_valid({strip('line')}) THEN 'valid' ELSE 'invalid' END AS status
      FROM {EVENT_LINES_SQL})
""")
def jsonl_valid_lines(spark, sf):
    c = N.classify_lines(_event_lines(Tables(spark, sf)))
    return c.select("line_no", "status", F.variant_get("value", "$.k", "string").alias("k"))


@register("top_category", f"""
SELECT line_no, json_keys(l)[1] AS top_category
FROM (SELECT event_id AS line_no, '{{"' || event_type || '": ' || props || ', "k": 1}}' AS l FROM events)
""")
def top_category(spark, sf):
    e = Tables(spark, sf).events
    lines = e.select(F.col("event_id").alias("line_no"),
                     F.concat(F.lit('{"'), "event_type", F.lit('": '), "props", F.lit(', "k": 1}')).alias("line"))
    return N.top_category(lines).select("line_no", "top_category")


def _lecture_objects(t: Tables):
    """Lecture-like JSON objects from documents with keys dropped/nulled by ``doc_id % 5``."""
    d = t.documents
    m = F.col("doc_id") % 5
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    obj = (F.when(m == 0, F.to_json(F.struct(url.alias("lecture_url"), F.col("text").alias("content"))))
           .when(m == 1, F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content"))))
           .when(m == 2, F.concat(F.lit('{"title": "t", "lecture_url": "u", "content": null}')))
           .when(m == 3, F.to_json(F.struct(F.col("source").alias("title"), url.alias("lecture_url"))))
           .otherwise(F.to_json(F.struct(F.col("source").alias("title"), url.alias("lecture_url"),
                                         F.col("text").alias("content")))))
    return d.select("doc_id", obj.alias("obj"))


@register("lecture_gate", """
SELECT doc_id, json_exists(obj, '$.content') AND json_exists(obj, '$.lecture_url') AS index_gate,
       json_exists(obj, '$.content') AND json_exists(obj, '$.lecture_url') AND json_exists(obj, '$.title') AS synth_gate
FROM (SELECT doc_id, CASE doc_id % 5
          WHEN 0 THEN json_object('lecture_url', 'doc/' || doc_id, 'content', text)
          WHEN 1 THEN json_object('title', source, 'content', text)
          WHEN 2 THEN '{"title": "t", "lecture_url": "u", "content": null}'::JSON
          WHEN 3 THEN json_object('title', source, 'lecture_url', 'doc/' || doc_id)
          ELSE json_object('title', source, 'lecture_url', 'doc/' || doc_id, 'content', text) END AS obj
      FROM documents)
""")
def lecture_gate(spark, sf):
    o = _lecture_objects(Tables(spark, sf)).withColumn("v", F.parse_json("obj"))
    return o.select("doc_id", N.index_gate(F.col("v")).alias("index_gate"),
                    N.synth_gate(F.col("v")).alias("synth_gate"))


def nested_lines(t: Tables):
    lec = lecture_view(t.documents).select(
        "doc_id", "category", "section", F.col("title").alias("lecture_title"), "url",
        F.col("url").alias("lecture_url"), "content",
        F.concat_ws(" > ", "category", "section").alias("path"), "title")
    return N.nest_lectures(lec, max_per_line=LINES_PER_LIST)


@register("nest_flatten_roundtrip", f"""
SELECT title, url, category || ' > ' || section AS path, length(content) AS n_chars, md5(content) AS content_md5
FROM {LECTURES}
""")
def nest_flatten_roundtrip(spark, sf):
    """K3 then A1 + B1: documents -> nested JSON lines -> parsed -> flattened documents."""
    docs, _quarantine = N.flatten_lectures(nested_lines(Tables(spark, sf)))
    return docs.select("title", "url", "path", F.length("content").alias("n_chars"),
                       F.md5("content").alias("content_md5"))


@register("category_filter", f"""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN ' ' || lang || chr(160) WHEN 1 THEN lang ELSE upper(lang) END AS name
  FROM documents)
WHERE {strip('name')} IN ('en', 'fr', 'ar')
""")
def category_filter(spark, sf):
    d = Tables(spark, sf).documents
    m = F.col("doc_id") % 3
    name = (F.when(m == 0, F.concat(F.lit(" "), "lang", F.lit(" ")))
            .when(m == 1, F.col("lang")).otherwise(F.upper("lang")))
    allowed = spark.createDataFrame([("en",), ("fr",), ("ar",)], "category string")
    return N.category_filter(d.withColumn("name", name), allowed).select("doc_id", "lang")


SECTION_SQL = f"""
(SELECT category, section, doc_id // {LINES_PER_LIST} AS list_no, count(*) AS n_lectures,
        string_agg(chr(10) || 'Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || content || chr(10), '' ORDER BY doc_id) AS section_text,
        array_to_string(list_sort(list_distinct(list(title || ' (' || url || ')'))), ' | ') AS refs
 FROM {LECTURES} GROUP BY category, section, doc_id // {LINES_PER_LIST})
"""


def section_frame(spark, sf):
    lec = lecture_view(Tables(spark, sf).documents).withColumn("list_no", F.floor(F.col("doc_id") / LINES_PER_LIST))
    return N.section_text(lec, list_keys=["category", "section", "list_no"])


@register("section_text", f"""
SELECT category, section, list_no, n_lectures, length(section_text) AS n_chars, md5(section_text) AS text_md5
FROM {SECTION_SQL}
""")
def section_text(spark, sf):
    s = section_frame(spark, sf)
    return s.select("category", "section", F.col("list_no").cast("long").alias("list_no"), "n_lectures",
                    F.length("section_text").alias("n_chars"), F.md5("section_text").alias("text_md5"))


@register("section_refs", f"SELECT category, section, list_no, refs FROM {SECTION_SQL}")
def section_refs(spark, sf):
    s = section_frame(spark, sf)
    return s.select("category", "section", F.col("list_no").cast("long").alias("list_no"),
                    F.array_join("references", " | ").alias("refs"))


@register("section_merge", f"""
SELECT category, section, count(*) AS n_lectures, count(DISTINCT path) AS n_paths
FROM (SELECT category, CASE WHEN doc_id % 2 = 0 THEN section ELSE 'deep > ' || section END AS sub, section,
             category || ' > ' || CASE WHEN doc_id % 2 = 0 THEN section ELSE 'deep > ' || section END AS path
      FROM {LECTURES})
GROUP BY category, section
""")
def section_merge(spark, sf):
    lec = lecture_view(Tables(spark, sf).documents)
    sub = F.when(F.col("doc_id") % 2 == 0, F.col("section")).otherwise(F.concat(F.lit("deep > "), "section"))
    lec = lec.withColumn("path", F.concat_ws(" > ", "category", sub))
    return N.section_merge(lec)


@register("flatten_ordered", f"""
SELECT title, url, category || ' > ' || section AS path, md5(content) AS content_md5,
       row_number() OVER (PARTITION BY category, section, doc_id // {LINES_PER_LIST} ORDER BY doc_id) - 1 AS item_no
FROM {LECTURES}
""")
def flatten_ordered(spark, sf):
    """K3 then B1 ordered mode: lectures come back with their position in the line."""
    lines = nested_lines(Tables(spark, sf))
    docs = N.flatten_lectures_ordered(lines).where(F.col("status") == "ok")
    return docs.select("title", "url", "path", F.md5("content").alias("content_md5"), "item_no")


@register("synthesis_sections", f"""
SELECT category, section, list_no, 0::BIGINT AS list_ord, n_lectures, md5(section_text) AS text_md5 FROM {SECTION_SQL}
""")
def synthesis_sections(spark, sf):
    """Synthesis walk of the nested lines (first key, category paths, title gate), then G1
    text per list in walk order."""
    lines = nested_lines(Tables(spark, sf))
    lec = (N.flatten_lectures_ordered(lines, keys=["category", "section", "block"], mode="synthesis")
           .where(F.col("status") == "ok"))
    s = N.section_text(lec, list_keys=["category", "section", "block", "list_ord"], order="item_no")
    return s.select("category", "section", F.col("block").cast("long").alias("list_no"), "list_ord",
                    "n_lectures", F.md5("section_text").alias("text_md5"))
