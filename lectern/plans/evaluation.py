"""Evaluation queries over ``documents`` (datasets = languages) graded by ``labels``.

Grader replies are derived from the labels: quality 1 -> "GRADE: CORRECT",
0 -> "GRADE: INCORRECT", quality 1 and toxic 1 -> an echo "CORRECT or
INCORRECT" (which must count as INCORRECT), no label -> "" (UNKNOWN).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import templates as TPL
from lectern.functions.text import REFUSAL_SENTENCE, token_estimate
from lectern.operators import chat as C
from lectern.operators import evaluate as E
from lectern.operators import prompts as P
from lectern.operators import text as X
from lectern.plans.registry import Tables, register
from lectern.plans.retrieval import _fill_sql
from lectern.plans.sqlparts import q, strip
from lectern.sources.corpus import lecture_view

CATEGORIES = ["en", "fr", "de", "es", "ar"]  # listed categories; "ar" has no rows


def eval_frame(t: Tables):
    lec = lecture_view(t.documents)
    j = lec.join(t.labels, "doc_id", "left")
    reply = (F.when(F.col("quality").isNull(), F.lit(""))
             .when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit("CORRECT or INCORRECT"))
             .when(F.col("quality") == 1, F.lit("GRADE: CORRECT"))
             .otherwise(F.lit("GRADE: INCORRECT")))
    return E.with_score(j.select(
        F.col("category").alias("dataset"), "section", F.col("doc_id").alias("row_id"),
        F.col("title").alias("question"), F.col("content").alias("answer"),
        F.lit("").alias("model_answer"), reply.alias("grader_reply")))


EVAL_SQL = """
(SELECT *, CASE WHEN contains(grader_reply, 'INCORRECT') THEN 'INCORRECT'
                WHEN contains(grader_reply, 'CORRECT') THEN 'CORRECT' ELSE 'UNKNOWN' END AS model_score
 FROM (SELECT d.lang AS dataset, d.source AS section, d.doc_id AS row_id,
              d.source || ' #' || CAST(d.doc_id AS VARCHAR) AS question, d.text AS answer, '' AS model_answer,
              CASE WHEN l.quality IS NULL THEN '' WHEN l.quality = 1 AND l.toxic = 1 THEN 'CORRECT or INCORRECT'
                   WHEN l.quality = 1 THEN 'GRADE: CORRECT' ELSE 'GRADE: INCORRECT' END AS grader_reply
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))
"""

SUMMARY_SQL = f"""
(SELECT dataset, count(*) AS total, count_if(model_score = 'CORRECT') AS correct,
        count_if(model_score = 'INCORRECT') AS incorrect, count_if(model_score = 'UNKNOWN') AS unknown,
        coalesce(count_if(model_score = 'CORRECT') / count(*), 0.0) AS accuracy
 FROM {EVAL_SQL} GROUP BY dataset)
"""


@register("grade_labels", f"SELECT row_id, grader_reply, model_score FROM {EVAL_SQL}")
def grade_labels(spark, sf):
    return eval_frame(Tables(spark, sf)).select("row_id", "grader_reply", "model_score")


@register("eval_summary", f"SELECT dataset, total, correct, incorrect, unknown, round(accuracy, 6) AS accuracy FROM {SUMMARY_SQL}")
def eval_summary(spark, sf):
    s = E.dataset_summary(eval_frame(Tables(spark, sf)))
    return s.withColumn("accuracy", F.round("accuracy", 6))


@register("label_examples", f"""
SELECT dataset, model_score, row_id,
       row_number() OVER (PARTITION BY dataset, model_score ORDER BY row_id) AS example_no
FROM {EVAL_SQL} QUALIFY example_no <= 3
""")
def label_examples(spark, sf):
    ex = E.label_examples(eval_frame(Tables(spark, sf)))
    return ex.select("dataset", "model_score", "row_id", F.col("example_no").cast("long").alias("example_no"))


def _report_sql() -> str:
    closing = """concat_ws(chr(10), CASE WHEN s.unknown > 0 THEN 'Without a grade: ' || s.unknown || ' of ' || s.total || ' rows; their replies name neither label.' END,
                  CASE WHEN s.incorrect > 0 THEN 'Graded incorrect: ' || s.incorrect || ' of ' || s.total || ' rows; the first are listed above.' END,
                  CASE WHEN s.unknown = 0 AND s.incorrect = 0 THEN 'All ' || s.total || ' rows are graded correct.' END) || chr(10)"""
    blk = "printf('Q: %s\nReference: %s\nModel: %s\n', coalesce(question, ''), coalesce(answer, ''), coalesce(model_answer, ''))"
    bp = "CASE WHEN total > 0 THEN floor((correct * 20000 + total) / (total * 2)) ELSE 0 END::BIGINT"
    return f"""
WITH ex AS (SELECT dataset, model_score, row_id, {blk} AS block,
                   row_number() OVER (PARTITION BY dataset, model_score ORDER BY row_id) AS rn
            FROM {EVAL_SQL} WHERE model_score IN ('CORRECT', 'INCORRECT') QUALIFY rn <= 3),
     b AS (SELECT dataset,
                  string_agg(CASE WHEN model_score = 'CORRECT' THEN block END, chr(10) ORDER BY row_id) AS ok_blocks,
                  string_agg(CASE WHEN model_score = 'INCORRECT' THEN block END, chr(10) ORDER BY row_id) AS bad_blocks
           FROM ex GROUP BY dataset),
     s AS (SELECT *, {bp} AS bp FROM {SUMMARY_SQL})
SELECT s.dataset, s.total, s.correct, round(s.accuracy, 6) AS accuracy,
       '=== Evaluation for ' || s.dataset || ' ===' || chr(10) ||
       'Total samples: ' || s.total || chr(10) || 'Correct: ' || s.correct || chr(10) ||
       'Incorrect: ' || s.incorrect || chr(10) || 'Unknown: ' || s.unknown || chr(10) ||
       'Accuracy: ' || printf('%d.%02d%%', s.bp // 100, s.bp % 100) || chr(10) || chr(10) ||
       'Some correct examples:' || chr(10) || '-------------------' || chr(10) || coalesce(b.ok_blocks, '') || chr(10) ||
       'Some incorrect examples:' || chr(10) || '-------------------' || chr(10) || coalesce(b.bad_blocks, '') || chr(10) ||
       {closing} AS report
FROM s LEFT JOIN b ON b.dataset = s.dataset
"""


@register("eval_report", _report_sql())
def eval_report(spark, sf):
    r = E.dataset_report(eval_frame(Tables(spark, sf)))
    return r.withColumn("accuracy", F.round("accuracy", 6))


@register("eval_combined_report", f"""
SELECT string_agg(report, chr(10) || chr(10) ORDER BY dataset) AS report FROM ({_report_sql()})
""")
def eval_combined_report(spark, sf):
    return E.combined_report(E.dataset_report(eval_frame(Tables(spark, sf))))


@register("eval_rollup", f"""
SELECT dataset, section, count(*) AS total, count_if(model_score = 'CORRECT') AS correct,
       round(coalesce(count_if(model_score = 'CORRECT') / count(*), 0.0), 6) AS accuracy
FROM {EVAL_SQL} GROUP BY ROLLUP (dataset, section)
""")
def eval_rollup(spark, sf):
    r = E.score_rollup(eval_frame(Tables(spark, sf)), "dataset", "section")
    return r.withColumn("accuracy", F.round("accuracy", 6))


@register("category_counts", f"""
SELECT c.lang, coalesce(n, 0) AS n
FROM (VALUES {", ".join(f"('{c}')" for c in CATEGORIES)}) c(lang)
LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d ON d.lang = c.lang
""")
def category_counts(spark, sf):
    cats = spark.createDataFrame([(c,) for c in CATEGORIES], "lang string")
    return E.counts_with_zeros(Tables(spark, sf).documents.select("lang"), cats, "lang")


PAIRS_SQL = """
(SELECT conv_id, turn, question, answer FROM
  (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS nrole, lead(text) OVER w AS answer
   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 WHERE role = 'user' AND nrole = 'assistant')
"""


@register("grade_join", f"""
SELECT p.conv_id, p.turn, CASE WHEN l.quality IS NULL THEN 'UNKNOWN' WHEN l.quality = 1 THEN 'CORRECT' ELSE 'INCORRECT' END AS model_score
FROM {PAIRS_SQL} p LEFT JOIN labels l ON l.doc_id = p.conv_id
""")
def grade_join(spark, sf):
    """Predictions paired with grades on the row key (never by position); ungraded ones stay, as UNKNOWN."""
    t = Tables(spark, sf)
    p = C.chat_pairs(t.conversations)
    j = p.join(t.labels.withColumnRenamed("doc_id", "conv_id"), "conv_id", "left")
    score = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("quality") == 1, "CORRECT").otherwise("INCORRECT")
    return j.select("conv_id", "turn", score.alias("model_score"))


@register("run_totals", f"""
SELECT count(*) AS n_pairs, count(DISTINCT conv_id) AS n_conversations,
       sum(ceil(length(question) / 4))::BIGINT AS question_tokens,
       sum(ceil(length(answer) / 4))::BIGINT AS answer_tokens
FROM {PAIRS_SQL}
""")
def run_totals(spark, sf):
    p = C.chat_pairs(Tables(spark, sf).conversations)
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("conv_id").alias("n_conversations"),
                 F.sum(token_estimate("question")).cast("long").alias("question_tokens"),
                 F.sum(token_estimate("answer")).cast("long").alias("answer_tokens"))


@register("refusal_autolabel", f"""
SELECT conv_id, turn,
       CASE WHEN contains(model_answer, {q(REFUSAL_SENTENCE)}) AND {strip('answer')} <> '' THEN 'INCORRECT'
            ELSE 'TO_GRADE' END AS auto_label
FROM (SELECT *, CASE WHEN length(question) % 4 = 0 THEN {q(REFUSAL_SENTENCE)} || ' ' || answer ELSE answer END
                AS model_answer FROM {PAIRS_SQL})
""")
def refusal_autolabel(spark, sf):
    p = C.chat_pairs(Tables(spark, sf).conversations)
    m = F.when(F.length("question") % 4 == 0, F.concat(F.lit(REFUSAL_SENTENCE + " "), F.col("answer"))) \
        .otherwise(F.col("answer"))
    p = p.withColumn("model_answer", m)
    return p.select("conv_id", "turn", F.coalesce(X.refusal_label(F.col("model_answer"), F.col("answer")),
                                                   F.lit("TO_GRADE")).alias("auto_label"))


GRADING_FILL = _fill_sql(TPL.GRADING_TEMPLATE, {"query": "question", "answer": "answer", "result": "model_answer"})


@register("grading_prompts", f"""
SELECT conv_id, turn, length(p) AS n_chars, md5(p) AS prompt_md5 FROM (
  SELECT conv_id, turn, {GRADING_FILL} AS p FROM (
    SELECT *, CASE WHEN length(question) % 4 = 0 THEN {q(REFUSAL_SENTENCE)} || ' ' || answer ELSE answer END AS model_answer
    FROM {PAIRS_SQL}))
""")
def grading_prompts(spark, sf):
    """Grading prompt per (question, reference answer, model answer)."""
    p = C.chat_pairs(Tables(spark, sf).conversations)
    m = F.when(F.length("question") % 4 == 0, F.concat(F.lit(REFUSAL_SENTENCE + " "), F.col("answer"))) \
        .otherwise(F.col("answer"))
    g = P.grading_prompts(p.withColumn("model_answer", m))
    return g.select("conv_id", "turn", F.length("grading_prompt").alias("n_chars"),
                    F.md5("grading_prompt").alias("prompt_md5"))


@register("provider_grades", f"""
SELECT conv_id, turn, CASE WHEN regexp_replace(trim(model_answer), '\\s+', ' ', 'g') = regexp_replace(trim(answer), '\\s+', ' ', 'g')
                           THEN 'CORRECT' ELSE 'INCORRECT' END AS model_score
FROM (SELECT *, CASE WHEN length(question) % 4 = 0 THEN {q(REFUSAL_SENTENCE)} || ' ' || answer ELSE answer END AS model_answer
      FROM {PAIRS_SQL})
""")
def provider_grades(spark, sf):
    """Provider plug point (batches of 100, bounded retry) with the offline grader, then Q10 labels."""
    from lectern.operators.provider import call_provider, exact_match_grader
    p = C.chat_pairs(Tables(spark, sf).conversations)
    m = F.when(F.length("question") % 4 == 0, F.concat(F.lit(REFUSAL_SENTENCE + " "), F.col("answer"))) \
        .otherwise(F.col("answer"))
    rows = p.withColumn("model_answer", m).select("conv_id", "turn", "answer", "model_answer")
    graded = call_provider(rows, exact_match_grader, "conv_id long, turn long, grader_reply string")
    return E.with_score(graded).select("conv_id", "turn", "model_score")
