"""Record-level text operators: marker split, blank filter, QA records,
completion parsing, answer length gate, token estimates, refusal and
``SOURCES:`` parsing.  All are narrow (no shuffle) built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import (ANSWER_MARKER, ANSWER_MARKER_ALT, FENCE_CHARS, MIN_ANSWER_LENGTH,
                                    REFUSAL_SENTENCE, is_blank, py_strip, strip_charset, token_estimate)


def _substr_from(text: Column, start: Column) -> Column:
    return F.substr(text, start)


def marker_split(df: DataFrame, text: str = "text", markers=(ANSWER_MARKER, ANSWER_MARKER_ALT)) -> DataFrame:
    """Split at the first occurrence of the first marker present; no marker ->
    question = answer = full text.  Both sides are stripped (Unicode whitespace)."""
    t = F.col(text)
    q = py_strip(t)
    a = py_strip(t)
    for m in reversed(markers):
        has = t.contains(m)
        q = F.when(has, py_strip(F.substring_index(t, m, 1))).otherwise(q)
        a = F.when(has, py_strip(_substr_from(t, F.instr(t, m) + F.lit(len(m))))).otherwise(a)
    return df.withColumn("question", q).withColumn("answer", a)


def drop_blank_qa(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Drop records whose question or answer is blank after a Unicode strip."""
    return df.where(~is_blank(question) & ~is_blank(answer))


def qa_records(df: DataFrame, *, category: Column, source: Column, question_type: str = "scraped",
               question: str = "question", answer: str = "answer") -> DataFrame:
    """Records in the QA JSONL layout (nested columns kept as struct/array)."""
    return df.select(
        category.alias("category_or_path"),
        F.lit(question_type).alias("question_type"),
        F.col(question).alias("question"),
        F.col(answer).alias("answer"),
        F.lit("N/A").alias("confidence"),
        F.array().cast("array<string>").alias("references_from_llm"),
        F.array(source).alias("source_lectures"),
        F.struct(F.lit(0).cast("long").alias("input_tokens"),
                 F.lit(0).cast("long").alias("output_tokens")).alias("token_usage"),
    )


def parse_completion(df: DataFrame, raw: str = "raw") -> DataFrame:
    """B18 + B19: fence cleanup (character-set strip), JSON parse, answer length gate.

    Adds ``payload`` (cleaned text), ``question``, ``answer``, ``confidence``
    (string, "N/A" when absent), ``references`` (a list; a single text is a list
    of one, elements that are no text are given as JSON, anything else is empty) and ``status`` in {ok, invalid_json, not_object,
    answer_not_text, short_answer, missing_question}; ``answer`` is null unless it is a JSON
    string (Q19).  Rows are kept: ``ok`` ones become records, the others are the quarantine.
    """
    cleaned = strip_charset(strip_charset(F.col(raw), FENCE_CHARS), "`")
    v = F.try_parse_json(cleaned)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.answer", "variant"))
    ans = F.when(kind == "STRING", F.try_variant_get(v, "$.answer", "string"))
    status = (F.when(v.isNull(), "invalid_json")
              .when(~is_obj, "not_object")
              .when(kind != "STRING", "answer_not_text")
              .when(F.length(F.coalesce(ans, F.lit(""))) < MIN_ANSWER_LENGTH, "short_answer")
              .when(F.try_variant_get(v, "$.question", "variant").isNull(), "missing_question")
              .otherwise("ok"))
    return (df.withColumn("payload", cleaned)
              .withColumn("question", F.try_variant_get(v, "$.question", "string"))
              .withColumn("answer", ans)
              .withColumn("confidence", F.coalesce(F.try_variant_get(v, "$.confidence", "string"), F.lit("N/A")))
              .withColumn("references", _references(v))
              .withColumn("status", status))


def _references(v: Column) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, "$.references", "variant"))
    one = F.array(F.try_variant_get(v, "$.references", "string"))
    many = F.try_variant_get(v, "$.references", "array<string>")
    return F.coalesce(F.when(kind == "STRING", one).when(kind.startswith("ARRAY"), many), F.array().cast("array<string>"))


def completion_records(parsed: DataFrame, *, category: Column, question_type: Column, sources: Column,
                       input_tokens: str = "input_tokens", output_tokens: str = "output_tokens") -> DataFrame:
    """B17 + B18: QA records of the ``ok`` rows of ``parse_completion``, with their references and the call's token usage."""
    return parsed.where(F.col("status") == "ok").select(
        category.alias("category_or_path"), question_type.alias("question_type"), "question", "answer", "confidence",
        F.col("references").alias("references_from_llm"), sources.alias("source_lectures"),
        F.struct(F.col(input_tokens).cast("long").alias("input_tokens"), F.col(output_tokens).cast("long").alias("output_tokens")).alias("token_usage"))


def min_answer_length(df: DataFrame, answer: str = "answer", n: int = MIN_ANSWER_LENGTH) -> DataFrame:
    """Keep answers of at least ``n`` code points."""
    return df.where(F.length(F.coalesce(F.col(answer), F.lit(""))) >= n)


def with_token_estimate(df: DataFrame, text: str = "text", out: str = "est_tokens") -> DataFrame:
    """Pluggable estimator, default ceil(chars / 4)."""
    return df.withColumn(out, token_estimate(text))


def refusal_label(model_answer: Column, reference: Column) -> Column:
    """INCORRECT when the model refused although a reference answer exists."""
    return F.when(F.coalesce(model_answer, F.lit("")).contains(REFUSAL_SENTENCE) & ~is_blank(reference),
                  F.lit("INCORRECT"))


def cited_sources(df: DataFrame, answer: str = "model_answer") -> DataFrame:
    """Split an answer at the first ``SOURCES:``; extract cited doc/URL tokens."""
    a = F.col(answer)
    has = a.contains("SOURCES:")
    body = F.when(has, py_strip(F.substring_index(a, "SOURCES:", 1))).otherwise(py_strip(a))
    tail = F.when(has, _substr_from(a, F.instr(a, "SOURCES:") + F.lit(len("SOURCES:"))))
    cites = F.regexp_extract_all(F.coalesce(tail, F.lit("")), F.lit(r"(https?://[^\s,]+|doc/[0-9]+)"), 1)
    return df.withColumn("answer_body", body).withColumn("cited", cites)
