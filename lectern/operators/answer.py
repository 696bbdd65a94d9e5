"""The evaluation flow: retrieved chunks -> context and prompts -> answers -> grades, joined on the question key.

Answering and grading go through the provider plug point; offline providers
stand in for the models.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.fixed import REFUSAL_SENTENCE
from lectern.operators import evaluate as E
from lectern.operators import prompts as P
from lectern.operators.provider import Provider, call_provider
from lectern.operators.text import refusal_label
from lectern.session import cut_lineage, summary_rows

#: Bytes of stated lines that are broadcast at a time.
LINES_SHIPPED = 16 << 20

_WORDS = re.compile(r"[^\x20\x09-\x0D]+( [^\x20\x09-\x0D]+){0,3}")


def matching_sentence(batch: pd.DataFrame) -> pd.DataFrame:
    """Offline answerer: from the question's first four words, where the context's first line that holds them has
    them, to the next full stop (which is added at the line's end); the refusal where no line does."""
    def reply(question, context) -> str:
        probe = _WORDS.search(question or "")
        hits = (x[x.index(probe[0]):].split(".")[0] + "." for x in (context or "").split("\n") if probe and probe[0] in x)
        return next(hits, REFUSAL_SENTENCE)
    out = batch.copy()
    out["model_answer"] = [reply(x, c) for x, c in zip(batch["question"], batch["context"])]
    return out


def same_words(batch: pd.DataFrame) -> pd.DataFrame:
    """Offline grader: CORRECT where answer and reference are the same words."""
    def norm(s) -> list[str]:
        return re.findall(r"[^\x20\x09-\x0D]+", s or "")
    out = batch.copy()
    out["grader_reply"] = ["GRADE: CORRECT" if norm(m) == norm(a) else "GRADE: INCORRECT" for m, a in zip(batch["model_answer"], batch["answer"])]
    return out


def _with_text(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])


def evaluate(questions: DataFrame, retrieved: DataFrame, answerer: Provider, grader: Provider, *, key: str = "item_id") -> DataFrame:
    """``questions`` (key, question, answer, ...) with context, source_list, model_sources, the prompts, model_answer,
    grader_reply and model_score.

    ``retrieved`` holds at most k rows a question: key, rank, content, title,
    url, path.  A question without any keeps a null context and no sources.
    Answers that hold the refusal sentence are INCORRECT where there is a
    reference; the others go to the grader.
    """
    retrieved = cut_lineage(retrieved)  # at most k rows a question, read for the context, the sources and each prompt
    sources = (retrieved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("title", "url", "path").alias("s")))).alias("x"))
               .select(key, F.col("x.s").alias("model_sources")))  # at most k a question
    told = P.stuff_context(retrieved, key=key).join(P.source_list(retrieved, key=key), key).join(sources, key)
    asked = questions.join(told.drop("n_docs"), key, "left")
    filled = P.prompt_table(asked.select(key, "question"), asked.select(key, "context"), key=key)
    asked = asked.join(filled, key)
    replied = call_provider(asked, answerer, _with_text(asked, "model_answer"))
    prompted = P.grading_prompts(replied)
    auto = refusal_label(F.col("model_answer"), F.col("answer"))
    graded = call_provider(prompted, grader, _with_text(prompted, "grader_reply"))
    return E.with_score(graded.withColumn("grader_reply", F.coalesce(auto, F.col("grader_reply"))))


def holding_documents(lines: DataFrame, docs: DataFrame, *, key: str, limit: int = LINES_SHIPPED) -> DataFrame:
    """(key, url) of the documents whose content holds a question's ``line`` anywhere (blank lines are held by none).

    The stated lines are dealt in lots of about ``limit`` bytes; each lot is
    broadcast and the documents are searched in place for all its lines
    at once, in time linear in the text (Aho-Corasick).
    """
    wanted = lines.where(F.trim("line") != "").select(F.col(key).cast("long").alias("key"), "line").distinct()
    size = wanted.agg(F.sum(F.octet_length("line") + 64)).first()[0] or 0
    lots = max(1, math.ceil(size / limit))
    out = None
    for lot in range(lots):
        own = wanted.where(F.pmod(F.xxhash64("key", "line"), F.lit(lots)) == lot)
        shared = docs.sparkSession.sparkContext.broadcast([(r.line, r.key) for r in summary_rows(own, limit)])  # at most about `limit` bytes

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            tree = ahocorasick.Automaton()
            for line, k in shared.value:
                tree.add_word(line, [*tree.get(line, []), k])
            if len(tree):
                tree.make_automaton()
            for batch in batches:
                hits = sorted({(k, url) for url, text in zip(*(c.to_pylist() for c in batch.columns)) if text is not None and len(tree)
                               for _, keys in tree.iter(text) for k in keys})
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.string())], ["key", "url"])
        part = docs.select("url", "content").mapInArrow(find, "key long, url string")
        out = part if out is None else out.unionByName(part)
    return out.distinct().withColumnRenamed("key", key)


def source_recall(retrieved: DataFrame, stored: DataFrame, *, key: str) -> DataFrame:
    """(key, n_stored, n_found): stored source urls of each question, and those among its retrieved urls."""
    found = retrieved.select(key, "url").distinct().withColumn("hit", F.lit(True))
    j = stored.select(key, "url").distinct().join(found, [key, "url"], "left")
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("n_stored"), F.count_if("hit").alias("n_found"))
