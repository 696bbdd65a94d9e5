"""Conversation history in linear space: one transcript per conversation, cut into segments; a turn's history is a prefix of it.

``chat.history_window`` writes every turn's history out, which grows with the
square of a conversation.  Here the answered pairs of a conversation are
written once, each turn keeps two numbers, and the text of a turn's history is put
together for the turns that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.chat import HISTORY_SEP, pair_text, user_turns
from lectern.operators.ordered import running_sum
from lectern.session import cut_lineage

#: Characters of a segment before its last pair.
SEGMENT_CHARS = 1 << 18


def turn_offsets(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, entry, n_pairs, history_chars, prefix) per user turn.

    ``entry`` is the turn's own pair (null without an answer); the others describe the turns
    before: their pairs, the characters of these, and the length of the joined history.
    """
    t = user_turns(conversations)
    entry = F.when(F.col("answer").isNotNull(), pair_text(F.col("question"), F.col("answer")))
    t = cut_lineage(t.select("conv_id", "turn", "question", entry.alias("entry")))
    t = t.withColumn("_pair", F.col("entry").isNotNull().cast("long")).withColumn("_chars", F.coalesce(F.length("entry"), F.lit(0)).cast("long"))
    t = running_sum(t, keys=["conv_id"], order="turn", value="_pair", out="n_pairs")
    t = running_sum(t, keys=["conv_id"], order="turn", value="_chars", out="history_chars")
    gaps = F.greatest(F.col("n_pairs") - 1, F.lit(0)) * len(HISTORY_SEP)
    return t.withColumn("prefix", F.col("history_chars") + gaps).drop("_pair", "_chars")


def transcript_segments(offsets: DataFrame, *, limit: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, seg_no, start, text): the pairs of each conversation in order, in rows of fewer than ``limit``
    characters before their last pair; ``start`` is the place of the row's text in the whole transcript."""
    start = F.col("history_chars") + F.col("n_pairs") * len(HISTORY_SEP)
    e = offsets.where(F.col("entry").isNotNull()).select("conv_id", "turn", "entry", start.alias("start"))
    e = e.withColumn("seg_no", F.floor(F.col("start") / limit).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "entry")))  # bounded by `limit` and one pair
    return e.groupBy("conv_id", "seg_no").agg(F.min("start").alias("start"), F.array_join(F.transform(ordered, lambda x: x["entry"]), HISTORY_SEP).alias("text"))


def histories(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """(conv_id, turn, history_text) of the turns in ``wanted`` (conv_id, turn, prefix): prefixes of their transcripts."""
    w = wanted.select("conv_id", "turn", "prefix")
    s = segments.withColumnRenamed("conv_id", "_conv")
    j = w.join(s, (F.col("conv_id") == F.col("_conv")) & (F.col("start") < F.col("prefix")))
    part = F.substr("text", F.lit(1), F.least(F.length("text").cast("long"), F.col("prefix") - F.col("start")).cast("int"))
    parts = j.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seg_no", part.alias("part")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), HISTORY_SEP)
    return w.join(parts, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(text, F.lit("")).alias("history_text"))
