"""Text and record queries over whole ``documents`` and ``conversations`` texts.

Test texts contain no Arabic, so Arabic literals (diacritics, answer markers)
are spliced into every row by a fixed rule, identically on the SQL side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import (ANSWER_MARKER, ANSWER_MARKER_ALT, FENCE_CHARS,
                                    strip_diacritics, token_estimate, word_count)
from lectern.operators import chat as C
from lectern.operators import text as X
from lectern.plans.evaluation import PAIRS_SQL
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import diacritics, q, strip

ARABIC_SAMPLE = "العِلْمُ نُورٌ"  # a short phrase written with diacritics (fatha, kasra, damma, sukun, tanween)

USER_TURNS_SQL = """
(SELECT conv_id, turn, text AS question,
        CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer, role
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""


@register("strip_diacritics", f"""
SELECT doc_id, length(s) AS n_chars_out, md5(s) AS text_md5
FROM (SELECT doc_id, {diacritics("text || ' ' || " + q(ARABIC_SAMPLE))} AS s FROM documents)
""")
def strip_diacritics_q(spark, sf):
    d = Tables(spark, sf).documents
    s = strip_diacritics(F.concat(F.col("text"), F.lit(" " + ARABIC_SAMPLE)))
    return d.select("doc_id", F.length(s).alias("n_chars_out"), F.md5(s).alias("text_md5"))


@register("path_build", """
SELECT doc_id, 'ROOT > ' || lang || ' > ' || source AS index_path, lang || ' > ' || source AS synth_path
FROM documents
""")
def path_build(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.array_join(F.array(F.lit("ROOT"), "lang", "source"), " > ").alias("index_path"),
                    F.concat_ws(" > ", "lang", "source").alias("synth_path"))


def _marker_text(t: str, doc_id: str, src: str, sql: bool):
    m1, m2 = ANSWER_MARKER, ANSWER_MARKER_ALT
    if sql:
        return (f"CASE {doc_id} % 4 WHEN 0 THEN {t} || ' ' || {q(m1)} || ': ' || {src} "
                f"WHEN 1 THEN {t} || ' ' || {q(m1)} || ' a ' || {q(m1)} || ' b' "
                f"WHEN 2 THEN {t} || ' ' || {q(m2)} || ' ' || {src} ELSE {t} END")
    d = F.col(doc_id) % 4
    return (F.when(d == 0, F.concat(F.col(t), F.lit(f" {m1}: "), F.col(src)))
            .when(d == 1, F.concat(F.col(t), F.lit(f" {m1} a {m1} b")))
            .when(d == 2, F.concat(F.col(t), F.lit(f" {m2} "), F.col(src)))
            .otherwise(F.col(t)))


def _split_sql(t: str) -> tuple[str, str]:
    m1, m2 = q(ANSWER_MARKER), q(ANSWER_MARKER_ALT)
    qs = (f"CASE WHEN contains({t}, {m1}) THEN {strip(f'substr({t}, 1, position({m1} IN {t}) - 1)')} "
          f"WHEN contains({t}, {m2}) THEN {strip(f'substr({t}, 1, position({m2} IN {t}) - 1)')} ELSE {strip(t)} END")
    an = (f"CASE WHEN contains({t}, {m1}) THEN {strip(f'substr({t}, position({m1} IN {t}) + {len(ANSWER_MARKER)})')} "
          f"WHEN contains({t}, {m2}) THEN {strip(f'substr({t}, position({m2} IN {t}) + {len(ANSWER_MARKER_ALT)})')} "
          f"ELSE {strip(t)} END")
    return qs, an


@register("marker_split", f"""
SELECT doc_id, length(question) AS question_len, length(answer) AS answer_len,
       md5(question) AS question_md5, md5(answer) AS answer_md5
FROM (SELECT doc_id, {_split_sql('t')[0]} AS question, {_split_sql('t')[1]} AS answer
      FROM (SELECT doc_id, {_marker_text('text', 'doc_id', 'source', True)} AS t FROM documents))
""")
def marker_split(spark, sf):
    d = Tables(spark, sf).documents.withColumn("t", _marker_text("text", "doc_id", "source", False))
    s = X.marker_split(d, "t")
    return s.select("doc_id", F.length("question").alias("question_len"), F.length("answer").alias("answer_len"),
                    F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@register("drop_blank_qa", f"""
SELECT conv_id, turn FROM {USER_TURNS_SQL}
WHERE role = 'user' AND question IS NOT NULL AND answer IS NOT NULL
  AND {strip('question')} <> '' AND {strip('answer')} <> ''
""")
def drop_blank_qa(spark, sf):
    return X.drop_blank_qa(C.user_turns(Tables(spark, sf).conversations)).select("conv_id", "turn")


@register("qa_records", f"""
SELECT 'conv/' || conv_id AS category_or_path, 'scraped' AS question_type, question, answer,
       'N/A' AS confidence, '' AS references_from_llm, 'conv/' || conv_id || '#' || turn AS source_lectures,
       0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens
FROM {PAIRS_SQL} WHERE {strip('question')} <> '' AND {strip('answer')} <> ''
""")
def qa_records(spark, sf):
    p = X.drop_blank_qa(C.chat_pairs(Tables(spark, sf).conversations))
    r = X.qa_records(p, category=F.concat(F.lit("conv/"), F.col("conv_id").cast("string")),
                     source=F.format_string("conv/%d#%d", F.col("conv_id"), F.col("turn")))
    return r.select("category_or_path", "question_type", "question", "answer", "confidence",
                    F.array_join("references_from_llm", ",").alias("references_from_llm"),
                    F.array_join("source_lectures", ",").alias("source_lectures"),
                    F.col("token_usage.input_tokens").alias("input_tokens"),
                    F.col("token_usage.output_tokens").alias("output_tokens"))


@register("completion_parse", f"""
SELECT conv_id, turn, question, answer_len, confidence,
       CASE WHEN NOT json_valid(payload) THEN 'invalid_json'
            WHEN json_type(TRY_CAST(payload AS JSON)) <> 'OBJECT' THEN 'not_object'
            WHEN json_type(TRY_CAST(payload AS JSON), '$.answer') <> 'VARCHAR' THEN 'answer_not_text'
            WHEN answer_len < 40 THEN 'short_answer'
            WHEN NOT json_exists(TRY_CAST(payload AS JSON), '$.question') THEN 'missing_question' ELSE 'ok' END AS status
FROM (SELECT conv_id, turn, payload,
             CASE WHEN json_valid(payload) AND json_type(TRY_CAST(payload AS JSON)) = 'OBJECT' THEN TRY_CAST(payload AS JSON) ->> '$.question' END AS question,
             length(coalesce(CASE WHEN json_valid(payload) AND json_type(TRY_CAST(payload AS JSON)) = 'OBJECT' AND json_type(TRY_CAST(payload AS JSON), '$.answer') = 'VARCHAR' THEN TRY_CAST(payload AS JSON) ->> '$.answer' END, '')) AS answer_len,
             coalesce(CASE WHEN json_valid(payload) AND json_type(TRY_CAST(payload AS JSON)) = 'OBJECT' THEN TRY_CAST(payload AS JSON) ->> '$.confidence' END, 'N/A') AS confidence
      FROM (SELECT conv_id, turn, trim(trim(raw, {q(FENCE_CHARS)}), '`') AS payload
            FROM (SELECT conv_id, turn,
                         CASE turn % 3 WHEN 2 THEN 'json no ' || question
                              WHEN 1 THEN CASE conv_id % 5
                                WHEN 2 THEN to_json({{'answer': answer, 'confidence': turn}})::VARCHAR
                                WHEN 3 THEN to_json({{'question': question, 'answer': [answer]}})::VARCHAR
                                ELSE '```json' || to_json({{'question': question, 'answer': answer, 'confidence': turn}})::VARCHAR || '```' END
                              ELSE to_json([question, answer])::VARCHAR END AS raw
                  FROM {PAIRS_SQL})))
""")
def completion_parse(spark, sf):
    p = C.chat_pairs(Tables(spark, sf).conversations)
    raw = (F.when(F.col("turn") % 3 == 2, F.concat(F.lit("json no "), F.col("question")))
           .when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 5 == 2), F.to_json(F.struct("answer", F.col("turn").alias("confidence"))))
           .when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 5 == 3), F.to_json(F.struct("question", F.array("answer").alias("answer"))))
           .when(F.col("turn") % 3 == 1, F.concat(F.lit("```json"),
                 F.to_json(F.struct(F.col("question"), F.col("answer"), F.col("turn").alias("confidence"))),
                 F.lit("```")))
           .otherwise(F.to_json(F.array("question", "answer"))))
    r = X.parse_completion(p.withColumn("raw", raw))
    return r.select("conv_id", "turn", "question", F.length(F.coalesce("answer", F.lit(""))).alias("answer_len"),
                    "confidence", "status")


@register("min_answer_len", f"""
SELECT conv_id, turn, length(answer) AS answer_len FROM {PAIRS_SQL} WHERE length(answer) >= 40
""")
def min_answer_len(spark, sf):
    p = X.min_answer_length(C.chat_pairs(Tables(spark, sf).conversations))
    return p.select("conv_id", "turn", F.length("answer").alias("answer_len"))


@register("token_estimate", r"""
SELECT doc_id, ceil(length(text) / 4)::BIGINT AS est_tokens, len(regexp_extract_all(text, '\w+'))::BIGINT AS n_words
FROM documents
""")
def token_estimate_q(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", token_estimate("text").alias("est_tokens"), word_count("text").alias("n_words"))


@register("cited_sources", f"""
SELECT conv_id, turn, length(body) AS body_len, array_to_string(regexp_extract_all(tail, '(https?://[^\\s,]+|doc/[0-9]+)', 1), ',') AS cited
FROM (SELECT conv_id, turn,
             CASE WHEN contains(m, 'SOURCES:') THEN {strip("substr(m, 1, position('SOURCES:' IN m) - 1)")} ELSE {strip('m')} END AS body,
             CASE WHEN contains(m, 'SOURCES:') THEN substr(m, position('SOURCES:' IN m) + 8) ELSE '' END AS tail
      FROM (SELECT conv_id, turn, answer || chr(10) || 'SOURCES: doc/' || conv_id || ', https://example.org/t/' || turn AS m
            FROM {PAIRS_SQL}))
""")
def cited_sources(spark, sf):
    p = C.chat_pairs(Tables(spark, sf).conversations)
    m = F.concat(F.col("answer"), F.lit("\nSOURCES: doc/"), F.col("conv_id").cast("string"),
                 F.lit(", https://example.org/t/"), F.col("turn").cast("string"))
    r = X.cited_sources(p.withColumn("model_answer", m))
    return r.select("conv_id", "turn", F.length("answer_body").alias("body_len"),
                    F.array_join("cited", ",").alias("cited"))
