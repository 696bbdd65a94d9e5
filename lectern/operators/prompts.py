"""Retrieval assembly: context stuffing, numbered sources and prompt tables.

All operators aggregate per question with ordered ``listagg`` (a sort inside
each group) and fill templates by concatenating pre-split literal parts, so a
question that contains ``{context}`` is left as written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import templates as TPL
from lectern.functions.fixed import SOURCE_NO_PATH, SOURCE_NO_URL
from lectern.functions.text import fill_template

CONTEXT_SEPARATOR = "\n\n"


def _ordered_join(value, order, sep: str):
    """``listagg(value, sep) WITHIN GROUP (ORDER BY order)`` as a Column."""
    return F.expr(f"listagg({value}, '{_sql_str(sep)}') WITHIN GROUP (ORDER BY {order})")


def _sql_str(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")


def stuff_context(retrieved: DataFrame, *, key: str = "item_id", text: str = "content",
                  rank: str = "rank") -> DataFrame:
    """Retrieved chunks joined in rank order -> (key, n_docs, context)."""
    return (retrieved.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 _ordered_join(text, rank, CONTEXT_SEPARATOR).alias("context")))


def source_lines(retrieved: DataFrame, *, rank: str = "rank", url: str = "url",
                 path: str = "path") -> DataFrame:
    """W10 line text ``[i] url (Path=path)`` with defaults ``No URL`` / ``NoPath``."""
    return retrieved.withColumn(
        "source_line",
        F.format_string("[%d] %s (Path=%s)", F.col(rank),
                        F.coalesce(F.col(url), F.lit(SOURCE_NO_URL)),
                        F.coalesce(F.col(path), F.lit(SOURCE_NO_PATH))))


def source_list(retrieved: DataFrame, *, key: str = "item_id", rank: str = "rank") -> DataFrame:
    """Numbered source list per question, newline-joined in rank order."""
    return (source_lines(retrieved, rank=rank).groupBy(key)
            .agg(_ordered_join("source_line", rank, "\n").alias("sources")))


def prompt_table(questions: DataFrame, contexts: DataFrame, *, key: str = "item_id",
                 question: str = "question", system_template: str | None = TPL.SYSTEM_TEMPLATE,
                 human_template: str | None = TPL.HUMAN_TEMPLATE) -> DataFrame:
    """(key, system_prompt, user_prompt); default templates when none given."""
    system_template = system_template or TPL.DEFAULT_SYSTEM_TEMPLATE
    human_template = human_template or TPL.DEFAULT_HUMAN_TEMPLATE
    joined = questions.join(contexts, key, "left")
    return joined.select(
        key,
        F.lit(system_template).alias("system_prompt"),
        fill_template(human_template, {"question": F.col(question),
                                       "context": F.coalesce(F.col("context"), F.lit(""))})
        .alias("user_prompt"))


def grading_prompts(rows: DataFrame, *, query: str = "question", answer: str = "answer",
                    result: str = "model_answer", template: str = TPL.GRADING_TEMPLATE) -> DataFrame:
    """Grading prompt per evaluated row (str() of null is 'None' in the reference; we use '')."""
    return rows.withColumn("grading_prompt", fill_template(
        template, {"query": F.col(query), "answer": F.col(answer), "result": F.col(result)}))


def generation_prompts(sections: DataFrame, question_types: list[str], *, text: str = "section_text",
                       template: str = TPL.GENERATION_TEMPLATE) -> DataFrame:
    """C4: one prompt per (section, question type); the type list is a short fixed list."""
    return (sections.withColumn("question_type", F.explode(F.array(*[F.lit(x) for x in question_types])))
            .withColumn("prompt", fill_template(template, {"text": F.col(text),
                                                           "question_type": F.col("question_type")})))


def condense_prompts(history: DataFrame, *, question: str = "question",
                     history_text: str = "history_text", n_pairs: str = "n_pairs",
                     template: str = TPL.CONDENSE_TEMPLATE) -> DataFrame:
    """Standalone-question prompts for turns that have a non-empty history."""
    return (history.where(F.col(n_pairs) > 0)
            .withColumn("condense_prompt", fill_template(
                template, {"chat_history": F.col(history_text), "question": F.col(question)})))


def prompt_key(prompt: str = "prompt"):
    """J6 cache key: SHA-256 of the prompt text."""
    return F.sha2(F.col(prompt), 256)


def completion_lookup(prompts: DataFrame, completions: DataFrame, *, prompt: str = "prompt") -> DataFrame:
    """Distinct prompts left-joined to cached completions on the prompt hash."""
    keyed = prompts.select(prompt).distinct().withColumn("prompt_key", prompt_key(prompt))
    return keyed.join(completions, "prompt_key", "left")


def pending_prompts(prompts: DataFrame, completions: DataFrame, *, prompt: str = "prompt") -> DataFrame:
    """Prompts with no cached completion (left-anti join) = the work list."""
    keyed = prompts.select(prompt).distinct().withColumn("prompt_key", prompt_key(prompt))
    return keyed.join(completions.select("prompt_key"), "prompt_key", "left_anti")
