"""Conversation queries: pairs, running history, condensation prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import templates as TPL
from lectern.operators import chat as C
from lectern.operators import prompts as P
from lectern.operators import transcript as TR
from lectern.plans.registry import Tables, register
from lectern.plans.retrieval import _fill_sql

USER_TURNS_SQL = """
(SELECT conv_id, turn, text AS question,
        CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer, role
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""

HISTORY_SQL = f"""
(SELECT conv_id, turn, question,
        coalesce(sum(CASE WHEN answer IS NOT NULL THEN 1 ELSE 0 END) OVER w, 0) AS n_pairs,
        coalesce(sum(length('User: ' || question || chr(10) || 'Bot: ' || answer)) OVER w, 0) AS history_chars,
        coalesce(string_agg('User: ' || question || chr(10) || 'Bot: ' || answer, chr(10) ORDER BY turn) OVER w, '') AS history_text
 FROM {USER_TURNS_SQL} WHERE role = 'user'
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@register("chat_pairs", f"""
SELECT conv_id, turn, question, answer FROM {USER_TURNS_SQL} WHERE role = 'user' AND answer IS NOT NULL
""")
def chat_pairs(spark, sf):
    return C.chat_pairs(Tables(spark, sf).conversations)


@register("history_window", f"SELECT * FROM {HISTORY_SQL}")
def history_window(spark, sf):
    return C.history_window(Tables(spark, sf).conversations)


@register("condense_prompts", f"""
SELECT conv_id, turn, {_fill_sql(TPL.CONDENSE_TEMPLATE, {'chat_history': 'history_text', 'question': 'question'})}
       AS condense_prompt
FROM {HISTORY_SQL} WHERE n_pairs > 0
""")
def condense_prompts(spark, sf):
    h = C.history_window(Tables(spark, sf).conversations)
    return P.condense_prompts(h).select("conv_id", "turn", "condense_prompt")


def _conversation_sources(spark, sf):
    """Numbered sources per conversation: top-6 documents for the conversation's vector."""
    from lectern.operators.vectors import attach_metadata, knn_join
    from lectern.plans.retrieval import K
    from lectern.sources.corpus import index_vectors, lecture_view
    t = Tables(spark, sf)
    qv = (t.embeddings.select(F.col("vec_id").alias("conv_id"), "embedding")
          .join(t.conversations.select("conv_id").distinct(), "conv_id", "left_semi"))
    nn = knn_join(qv, index_vectors(t.embeddings, t.documents), K, query_id="conv_id", index_id="doc_id")
    meta = lecture_view(t.documents).select("doc_id", "url", "path")
    r = attach_metadata(nn, meta)
    return P.source_list(r, key="conv_id")


def _history_context_sql() -> str:
    from lectern.plans.retrieval import K
    from lectern.plans.sqlparts import LECTURES, sqdist
    return f"""
WITH qv AS (SELECT e.vec_id AS conv_id, e.embedding FROM embeddings e
            WHERE e.vec_id IN (SELECT conv_id FROM conversations)),
     xv AS (SELECT vec_id AS doc_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
     nn AS (SELECT qv.conv_id, xv.doc_id,
                   row_number() OVER (PARTITION BY qv.conv_id ORDER BY {sqdist('qv.embedding', 'xv.embedding')}, xv.doc_id) AS rank
            FROM qv JOIN xv ON TRUE QUALIFY rank <= {K}),
     src AS (SELECT nn.conv_id, string_agg(printf('[%d] %s (Path=%s)', nn.rank, l.url, l.path), chr(10) ORDER BY nn.rank) AS sources
             FROM nn JOIN {LECTURES} l ON l.doc_id = nn.doc_id GROUP BY nn.conv_id),
     t AS (SELECT u.conv_id, u.turn, u.question, u.answer, src.sources FROM {USER_TURNS_SQL} u
           LEFT JOIN src ON src.conv_id = u.conv_id WHERE u.role = 'user'),
     e AS (SELECT conv_id, turn,
                  CASE WHEN answer IS NOT NULL THEN concat_ws(chr(10), 'User: ' || question || chr(10) || 'Bot: ' || answer,
                       CASE WHEN sources IS NOT NULL THEN 'User: Context' || chr(10) || 'Bot: ' || sources END) END AS entry,
                  (answer IS NOT NULL)::BIGINT + (answer IS NOT NULL AND sources IS NOT NULL)::BIGINT AS n_entry
           FROM t)
SELECT conv_id, turn, coalesce(sum(n_entry) OVER w, 0) AS n_entries,
       coalesce(string_agg(entry, chr(10) ORDER BY turn) OVER w, '') AS history_text
FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


@register("history_with_context", _history_context_sql())
def history_with_context(spark, sf):
    """History where each answer is followed by a ("Context", numbered sources) pair."""
    t = Tables(spark, sf)
    src = _conversation_sources(spark, sf)
    per_turn = (C.user_turns(t.conversations).select("conv_id", "turn").join(src, "conv_id", "inner"))
    h = C.history_with_context(t.conversations, per_turn)
    return h.select("conv_id", "turn", F.col("n_entries").cast("long").alias("n_entries"), "history_text")


@register("transcript_segments", f"""
WITH e AS (SELECT conv_id, turn, entry, coalesce(sum(length(entry) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM (SELECT conv_id, turn, 'User: ' || question || chr(10) || 'Bot: ' || answer AS entry FROM {USER_TURNS_SQL} WHERE role = 'user' AND answer IS NOT NULL))
SELECT conv_id, (start // 1500)::BIGINT AS seg_no, min(start)::BIGINT AS start, md5(string_agg(entry, chr(10) ORDER BY turn)) AS text_md5 FROM e GROUP BY conv_id, start // 1500
""")
def transcript_segments(spark, sf):
    """W7 in linear space: every pair once, in segments of bounded size."""
    s = TR.transcript_segments(TR.turn_offsets(Tables(spark, sf).conversations), limit=1500)
    return s.select("conv_id", "seg_no", "start", F.md5("text").alias("text_md5"))


@register("history_on_demand", f"""
SELECT conv_id, turn, n_pairs, history_chars, length(history_text) AS prefix, md5(history_text) AS text_md5
FROM {HISTORY_SQL} WHERE (conv_id + turn) % 3 <> 1
""")
def history_on_demand(spark, sf):
    """W7 of the turns that are asked for, as prefixes of their transcripts."""
    o = TR.turn_offsets(Tables(spark, sf).conversations)
    wanted = o.where((F.col("conv_id") + F.col("turn")) % 3 != 1)
    h = TR.histories(wanted, TR.transcript_segments(o, limit=1500))
    return (wanted.select("conv_id", "turn", "n_pairs", "history_chars", "prefix").join(h, ["conv_id", "turn"])
            .select("conv_id", "turn", "n_pairs", "history_chars", "prefix", F.md5("history_text").alias("text_md5")))
