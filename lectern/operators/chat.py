"""Conversation operators: turn pairs, running history, sources after answers.

A conversation is ``(conv_id, turn, role, text)``.  History for a user turn is
the list of completed (user, assistant) pairs strictly before it.  The next
turn and the running counts use two-level (bucketed) helpers, so a very long
conversation is spread over tasks; only the joined history text, whose size
grows with the square of the conversation length, is a per-conversation window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import lead_columns, running_sum

HISTORY_SEP = "\n"


def _with_next(conversations: DataFrame) -> DataFrame:
    """Next turn's role and text (two-level lead: a long conversation is not one task)."""
    return lead_columns(conversations.select("conv_id", "turn", "role", "text"),
                        keys=["conv_id"], order="turn", cols=["role", "text"])


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn directly followed by an assistant turn -> (conv_id, turn, question, answer)."""
    nxt = _with_next(conversations)
    return (nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select("conv_id", "turn", F.col("text").alias("question"),
                    F.col("next_text").alias("answer")))


def user_turns(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant reply that follows it (null when none)."""
    return (_with_next(conversations)
            .where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("question"),
                    F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer")))


def pair_text(question, answer):
    return F.concat(F.lit("User: "), question, F.lit("\nBot: "), answer)


def history_window(conversations: DataFrame) -> DataFrame:
    """Per user turn, the completed pairs before it.

    Returns (conv_id, turn, question, n_pairs, history_chars, history_text).
    """
    turns = user_turns(conversations)
    done = F.col("answer").isNotNull()
    entry = F.when(done, pair_text(F.col("question"), F.col("answer")))
    t = (turns.withColumn("_done", done.cast("long"))
         .withColumn("_chars", F.coalesce(F.length(entry), F.lit(0)).cast("long")))
    t = running_sum(t, keys=["conv_id"], order="turn", value="_done", out="n_pairs")
    t = running_sum(t, keys=["conv_id"], order="turn", value="_chars", out="history_chars")
    # the joined text itself grows with the square of a conversation's length
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(
        "conv_id", "turn", "question", "n_pairs", "history_chars",
        F.array_join(F.collect_list(entry).over(w), HISTORY_SEP).alias("history_text"))


def history_with_context(conversations: DataFrame, sources: DataFrame) -> DataFrame:
    """History where every answered pair is followed by a ("Context", sources) pair.

    ``sources`` is ``(conv_id, turn, sources)`` for answered user turns; turns
    without sources add no context pair.
    """
    turns = user_turns(conversations).join(sources, ["conv_id", "turn"], "left")
    done = F.col("answer").isNotNull()
    ctx = F.when(done & F.col("sources").isNotNull(),
                 F.concat(F.lit("User: Context\nBot: "), F.col("sources")))
    entry = F.when(done, F.concat_ws(HISTORY_SEP, pair_text(F.col("question"), F.col("answer")), ctx))
    n_entry = done.cast("long") + ctx.isNotNull().cast("long")
    t = running_sum(turns.withColumn("_n", n_entry), keys=["conv_id"], order="turn", value="_n", out="n_entries")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(
        "conv_id", "turn", "n_entries",
        F.array_join(F.collect_list(entry).over(w), HISTORY_SEP).alias("history_text"))
