"""Corpus pipeline: language, repeated passages, near duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet in the shared
folder and rereads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, linededup, minhash, mixing, packing
from lectern.llm.common import WORD, saved
from lectern.llm.plans import crc32
from lectern.session import ensure_checkpoint_dir, read_table, ship_package

#: Documents predicted with a lower score are rejected (a score is the winner's posterior).
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null or hold no letter go."""
    ship_package(spark)
    model = language.LanguageModel.fit(docs.where(~language.held_out(F.col("doc_id"))))
    name = {c: c if c == "text" else f"own {c}" for c in docs.columns}  # none is replaced by a column of the prediction
    found = language.identify(docs.select(*[F.col(f"`{c}`").alias(name[c]) for c in docs.columns]), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.col(f"`{name[c]}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line passages removed from the texts; n_chars follows."""
    ship_package(spark)
    out = linededup.dedup_lines(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    ship_package(spark)
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them (0, 1 or 2 times), in slot order; the read
    at a source's target ends there, and n_chars follows.

    A document without a word (among them those that the line stage emptied,
    being copies in all their lines) has nothing to read and is left out.
    """
    ship_package(spark)
    out = mixing.mix_documents(docs.where(F.col("text").rlike(WORD)))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, one piece each."""
    ship_package(spark)
    p = packing.pack(docs)
    return p.select("doc_id", "start", "length", crc32("ids"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix", mix), ("pack", pack)]
#: The language model is trained, so SQL cannot express the stages; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
