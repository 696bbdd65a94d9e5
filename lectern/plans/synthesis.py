"""Q&A synthesis queries: quotas, token budget, near duplicates, question-type plan,
generation prompts, completion cache lookups and URL de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import templates as TPL
from lectern.functions.fixed import QUESTION_TYPES
from lectern.functions.text import is_blank
from lectern.functions.text import token_estimate
from lectern.operators import chat as C
from lectern.operators import neardup as ND
from lectern.operators import prompts as P
from lectern.operators import quota as QU
from lectern.operators.html import link_rows
from lectern.plans.html import (ARTICLE_LINES_SQL, NONBLANK_LINKS_SQL, TITLES_ALL_SQL, page_articles,
                                page_titles, pages_clean)
from lectern.plans.nested import LINES_PER_LIST, SECTION_SQL, section_frame
from lectern.plans.registry import Tables, register
from lectern.plans.retrieval import _fill_sql
from lectern.plans.sqlparts import q, strip

PLAN_TYPES = ["General", "Factual", "Reasoning"]  # wider list used to exercise the shuffle order
TIGHT_BUDGET = 100_000                  # a budget that binds on small scale factors


@register("qa_quota", f"""
WITH c AS (SELECT doc_id, lang, source, doc_id // {LINES_PER_LIST} AS list_no FROM documents WHERE length(text) >= 40),
s1 AS (SELECT *, row_number() OVER (PARTITION BY lang, source, list_no ORDER BY doc_id) AS list_rank FROM c QUALIFY list_rank <= 2),
s2 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS category_rank FROM s1 QUALIFY category_rank <= 20)
SELECT doc_id, lang AS category, source AS section, list_rank, category_rank FROM s2 ORDER BY doc_id LIMIT 100
""")
def qa_quota(spark, sf):
    d = Tables(spark, sf).documents
    cands = (d.where(F.length("text") >= 40)   # valid candidates only (B19), before ranking
             .select("doc_id", F.col("lang").alias("category"), F.col("source").alias("section"),
                     F.floor(F.col("doc_id") / LINES_PER_LIST).alias("list_no")))
    acc = QU.apply_quotas(cands, list_keys=["category", "section", "list_no"], category="category", order="doc_id")
    return acc.select("doc_id", "category", "section", F.col("list_rank").cast("long").alias("list_rank"),
                      F.col("category_rank").cast("long").alias("category_rank"))


def _budget_sql(budget: int) -> str:
    return f"""
WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id,
                            ceil(length(text) / 4)::BIGINT AS est_in,
                            (ceil(length(text) / 4) + ceil(length(text) / 40))::BIGINT AS cost FROM documents),
g(i, usage, acc, stop) AS (
  SELECT 0::BIGINT, 0::BIGINT, false, false
  UNION ALL
  SELECT c.i,
         CASE WHEN g.usage < {budget} AND g.usage + c.est_in <= {budget} THEN g.usage + c.cost ELSE g.usage END,
         g.usage < {budget} AND g.usage + c.est_in <= {budget},
         g.usage >= {budget}
  FROM g JOIN c ON c.i = g.i + 1 WHERE NOT g.stop)
SELECT c.doc_id, g.usage AS usage_after FROM g JOIN c ON c.i = g.i WHERE g.acc
"""


def _budget_query(spark, sf, budget: int):
    d = Tables(spark, sf).documents
    cands = d.select("doc_id", token_estimate("text").alias("est_in"),
                     (token_estimate("text") + F.ceil(F.length("text") / 40)).cast("long").alias("cost"))
    acc = QU.token_budget(cands, order="doc_id", est_in="est_in", cost="cost", budget=budget)
    return acc.select("doc_id", "usage_after")


@register("token_budget_greedy", _budget_sql(QU.TOKEN_BUDGET))
def token_budget_greedy(spark, sf):
    return _budget_query(spark, sf, QU.TOKEN_BUDGET)


@register("token_budget_tight", _budget_sql(TIGHT_BUDGET))
def token_budget_tight(spark, sf):
    return _budget_query(spark, sf, TIGHT_BUDGET)


QUESTIONS_ALL_SQL = "(SELECT conv_id * 100000 + turn AS id, text FROM conversations WHERE role = 'user')"


def _distinct_sql(all_sql: str) -> str:
    """One row per distinct non-empty text, represented by its smallest id."""
    return f"(SELECT min(id) AS id, text FROM {all_sql} WHERE length(text) > 0 GROUP BY text)"


def _encoded_sql(all_sql: str) -> str:
    """Pairs of distinct texts with ratio > 0.85.  DuckDB's levenshtein counts bytes, so
    every distinct lower-cased character is first mapped to its own single-byte code."""
    reps = _distinct_sql(all_sql)
    return f"""
chars AS (SELECT id, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS c
          FROM (SELECT id, regexp_extract_all(lower(text), '(?s).') AS cs FROM {reps})),
dict AS (SELECT c, row_number() OVER (ORDER BY c) AS code FROM (SELECT DISTINCT c FROM chars)),
enc AS (SELECT q.id, length(q.text) AS n, length(lower(q.text)) AS nl,
               coalesce((SELECT string_agg(chr(d.code::INTEGER), '' ORDER BY ch.pos)
                         FROM chars ch JOIN dict d ON d.c = ch.c WHERE ch.id = q.id), '') AS e
        FROM {reps} q),
near AS MATERIALIZED (SELECT a.id AS id_a, b.id AS id_b, a.e AS ea, b.e AS eb, greatest(a.n, b.n) AS longest
          FROM enc a JOIN enc b ON a.id < b.id AND abs(a.nl - b.nl) <= ceil(0.15 * greatest(a.n, b.n))),
dist AS MATERIALIZED (SELECT id_a, id_b, longest, levenshtein(ea, eb) AS distance FROM near),
pairs AS MATERIALIZED (SELECT id_a, id_b, distance, 1.0 - distance / longest AS ratio FROM dist
          WHERE 1.0 - distance / longest > 0.85)
"""


def _greedy_sql(all_sql: str) -> str:
    return f"""
WITH RECURSIVE {_encoded_sql(all_sql)},
ord AS (SELECT a.id, row_number() OVER (ORDER BY a.id) AS i, (length(a.text) > 0 AND a.id <> r.id) AS is_copy
        FROM {all_sql} a LEFT JOIN {_distinct_sql(all_sql)} r ON r.text = a.text),
g(i, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT o.i, CASE WHEN o.is_copy OR EXISTS (SELECT 1 FROM pairs p WHERE p.id_b = o.id AND list_contains(g.kept, p.id_a))
                   THEN g.kept ELSE list_append(g.kept, o.id) END
  FROM g JOIN ord o ON o.i = g.i + 1)
SELECT o.id, list_contains((SELECT kept FROM g ORDER BY i DESC LIMIT 1), o.id) AS kept FROM ord o
"""


QUESTIONS_SQL = _distinct_sql(QUESTIONS_ALL_SQL)
ENCODED_SQL = _encoded_sql(QUESTIONS_ALL_SQL)


def _questions(t: Tables):
    c = t.conversations.where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")


@register("near_dup_pairs", f"""
WITH {ENCODED_SQL}
SELECT id_a, id_b, distance, round(ratio, 6) AS ratio FROM pairs
""")
def near_dup_pairs(spark, sf):
    p = ND.near_duplicate_pairs(_questions(Tables(spark, sf)))
    return p.select("id_a", "id_b", F.col("distance").cast("long").alias("distance"),
                    F.round("ratio", 6).alias("ratio"))


@register("exact_copies", f"""
SELECT q.id, r.id AS rep_id FROM {QUESTIONS_ALL_SQL} q JOIN {QUESTIONS_SQL} r ON r.text = q.text
""")
def exact_copies(spark, sf):
    return ND.exact_copies(_questions(Tables(spark, sf))).select("id", "rep_id")


@register("near_dup_greedy", _greedy_sql(QUESTIONS_ALL_SQL))
def near_dup_greedy(spark, sf):
    r = ND.greedy_first_wins(_questions(Tables(spark, sf)))
    return r.select("id", "kept")


@register("question_type_plan", f"""
SELECT category, section, list_no, question_type,
       row_number() OVER (PARTITION BY category, section, list_no
                          ORDER BY md5(category || '|' || section || '|' || list_no || '|' || question_type)) AS type_order
FROM (SELECT DISTINCT lang AS category, source AS section, doc_id // {LINES_PER_LIST} AS list_no FROM documents),
     (SELECT unnest([{", ".join(q(x) for x in PLAN_TYPES)}]) AS question_type)
""")
def question_type_plan(spark, sf):
    """L4: question types per list in a seeded hash order (replaces an unseeded shuffle)."""
    from pyspark.sql import Window
    d = Tables(spark, sf).documents
    lists = d.select(F.col("lang").alias("category"), F.col("source").alias("section"),
                     F.floor(F.col("doc_id") / LINES_PER_LIST).cast("long").alias("list_no")).distinct()
    plan = lists.withColumn("question_type", F.explode(F.array(*[F.lit(x) for x in PLAN_TYPES])))
    key = F.md5(F.concat_ws("|", "category", "section", F.col("list_no").cast("string"), "question_type"))
    w = Window.partitionBy("category", "section", "list_no").orderBy(key)
    return plan.withColumn("type_order", F.row_number().over(w).cast("long"))


@register("generation_prompts", f"""
SELECT category, section, list_no, 'General' AS question_type,
       md5({_fill_sql(TPL.GENERATION_TEMPLATE, {'text': 'section_text', 'question_type': "'General'"})}) AS prompt_md5
FROM {SECTION_SQL}
""")
def generation_prompts(spark, sf):
    """C4: section text x question type -> generation prompt."""
    p = P.generation_prompts(section_frame(spark, sf), QUESTION_TYPES)
    return p.select("category", F.col("section"), F.col("list_no").cast("long").alias("list_no"),
                    "question_type", F.md5("prompt").alias("prompt_md5"))


CACHE_SQL = """
(SELECT sha256(question) AS prompt_key, min(answer) AS completion FROM
  (SELECT text AS question, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer, role
   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 WHERE role = 'user' AND answer IS NOT NULL GROUP BY 1)
"""


def _cache(t: Tables):
    p = C.chat_pairs(t.conversations)
    return (p.groupBy(P.prompt_key("question").alias("prompt_key"))
            .agg(F.min("answer").alias("completion")))


def _prompts(t: Tables):
    return t.conversations.where(F.col("role") == "user").select(F.col("text").alias("prompt"))


@register("completion_lookup", f"""
SELECT sha256(prompt) AS prompt_key, c.completion IS NOT NULL AS cached, length(c.completion) AS completion_len
FROM (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user') p
LEFT JOIN {CACHE_SQL} c ON c.prompt_key = sha256(p.prompt)
""")
def completion_lookup(spark, sf):
    t = Tables(spark, sf)
    r = P.completion_lookup(_prompts(t), _cache(t))
    return r.select("prompt_key", F.col("completion").isNotNull().alias("cached"),
                    F.length("completion").alias("completion_len"))


@register("pending_prompts", f"""
SELECT sha256(prompt) AS prompt_key FROM (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user') p
WHERE sha256(prompt) NOT IN (SELECT prompt_key FROM {CACHE_SQL})
""")
def pending_prompts(spark, sf):
    t = Tables(spark, sf)
    return P.pending_prompts(_prompts(t), _cache(t)).select("prompt_key")


@register("dedup_urls", f"""
SELECT href, min(page_id * 100000 + link_no) // 100000 AS page_id, min(page_id * 100000 + link_no) % 100000 AS link_no,
       count(*) AS n_seen
FROM {NONBLANK_LINKS_SQL} GROUP BY href
""")
def dedup_urls(spark, sf):
    """One row per URL at its first occurrence (aggregation with partial merge, no window)."""
    links = link_rows(pages_clean(Tables(spark, sf)))
    g = links.groupBy("href").agg(F.min(F.struct("page_id", "link_no")).alias("first"),
                                  F.count(F.lit(1)).alias("n_seen"))
    return g.select("href", F.col("first.page_id").alias("page_id"), F.col("first.link_no").alias("link_no"),
                    "n_seen")


@register("synthesis_plan", f"""
WITH s AS (SELECT category, section, list_no, min_doc, section_text FROM (
             SELECT *, (SELECT min(doc_id) FROM documents d WHERE d.lang = x.category AND d.source = x.section
                        AND d.doc_id // {LINES_PER_LIST} = x.list_no) AS min_doc FROM {SECTION_SQL} x)),
c AS (SELECT category, section, list_no, min_doc, unnest([{", ".join(q(x) for x in QUESTION_TYPES)}]) AS question_type
      FROM s WHERE {strip('section_text')} <> ''),
s1 AS (SELECT *, row_number() OVER (PARTITION BY category, section, list_no ORDER BY min_doc, question_type) AS list_rank
       FROM c QUALIFY list_rank <= 2),
s2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY min_doc, question_type) AS category_rank
       FROM s1 QUALIFY category_rank <= 20)
SELECT category, section, list_no, question_type, list_rank, category_rank FROM s2
ORDER BY min_doc, question_type LIMIT 100
""")
def synthesis_plan(spark, sf):
    """Reference synthesis flow without the model call: lists (G1) x question types,
    in list order, capped per list / category / total (one type -> one Q&A per list)."""
    from lectern.functions.text import is_blank
    t = Tables(spark, sf)
    first = (t.documents.groupBy(F.col("lang").alias("category"), F.col("source").alias("section"),
                                 F.floor(F.col("doc_id") / LINES_PER_LIST).alias("list_no"))
             .agg(F.min("doc_id").alias("min_doc")))
    s = section_frame(spark, sf).join(first, ["category", "section", "list_no"])
    cands = (s.where(~is_blank("section_text"))
             .withColumn("question_type", F.explode(F.array(*[F.lit(x) for x in QUESTION_TYPES])))
             .withColumn("ord", F.struct("min_doc", "question_type")))
    acc = QU.apply_quotas(cands, list_keys=["category", "section", "list_no"], category="category", order="ord")
    return acc.select("category", "section", F.col("list_no").cast("long").alias("list_no"), "question_type",
                      F.col("list_rank").cast("long").alias("list_rank"),
                      F.col("category_rank").cast("long").alias("category_rank"))


def _strict_sql(budget: int) -> str:
    ok = (f"(g.n < {QU.MAX_TOTAL} AND g.usage < {budget} AND coalesce(g.lists[c.lst], 0) < {QU.MAX_PER_LIST} "
          f"AND coalesce(g.cats[c.cat], 0) < {QU.MAX_PER_CATEGORY} AND g.usage + c.est <= {budget})")
    return f"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, lang AS cat,
         lang || '|' || source || '|' || (doc_id // {LINES_PER_LIST}) AS lst,
         ceil(length(text) / 4)::BIGINT AS est,
         (ceil(length(text) / 4) + ceil(length(text) / 40))::BIGINT AS cost
  FROM documents WHERE length(text) >= 40),
g(i, usage, n, lists, cats, acc) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, MAP {{}}::MAP(VARCHAR, BIGINT), MAP {{}}::MAP(VARCHAR, BIGINT), false
  UNION ALL
  SELECT c.i,
         CASE WHEN {ok} THEN g.usage + c.cost ELSE g.usage END,
         CASE WHEN {ok} THEN g.n + 1 ELSE g.n END,
         CASE WHEN {ok} THEN map_concat(g.lists, MAP {{c.lst: coalesce(g.lists[c.lst], 0) + 1}}) ELSE g.lists END,
         CASE WHEN {ok} THEN map_concat(g.cats, MAP {{c.cat: coalesce(g.cats[c.cat], 0) + 1}}) ELSE g.cats END,
         {ok}
  FROM g JOIN c ON c.i = g.i + 1
  WHERE g.n < {QU.MAX_TOTAL} AND g.usage < {budget})
SELECT c.doc_id, g.usage AS usage_after FROM g JOIN c ON c.i = g.i WHERE g.acc
"""


@register("synthesis_strict", _strict_sql(TIGHT_BUDGET))
def synthesis_strict(spark, sf):
    """Strict fold: caps 2 / 20 / 100 and the token budget interleaved exactly as the
    sequential loop (candidates = documents in order, lists = (category, section, block))."""
    d = Tables(spark, sf).documents.where(F.length("text") >= 40)
    cands = d.select("doc_id", F.col("lang").alias("category"), F.col("source").alias("section"),
                     F.floor(F.col("doc_id") / LINES_PER_LIST).alias("list_no"),
                     token_estimate("text").alias("est_in"),
                     (token_estimate("text") + F.ceil(F.length("text") / 40)).cast("long").alias("cost"))
    acc = QU.strict_fold(cands, order="doc_id", list_keys=["category", "section", "list_no"], category="category",
                         est_in="est_in", cost="cost", budget=TIGHT_BUDGET)
    return acc.select("doc_id", "usage_after")


@register("near_dup_titles", f"""
WITH {_encoded_sql(TITLES_ALL_SQL)}
SELECT id_a, id_b, distance, round(ratio, 6) AS ratio FROM pairs
""")
def near_dup_titles(spark, sf):
    """J4 on harvested page headings (whole titles): pairs of distinct titles with ratio > 0.85."""
    p = ND.near_duplicate_pairs(page_titles(Tables(spark, sf)))
    return p.select("id_a", "id_b", F.col("distance").cast("long").alias("distance"),
                    F.round("ratio", 6).alias("ratio"))


@register("title_copies", f"""
SELECT q.id, r.id AS rep_id FROM {TITLES_ALL_SQL} q JOIN {_distinct_sql(TITLES_ALL_SQL)} r ON r.text = q.text
""")
def title_copies(spark, sf):
    return ND.exact_copies(page_titles(Tables(spark, sf))).select("id", "rep_id")


@register("near_dup_titles_greedy", _greedy_sql(TITLES_ALL_SQL))
def near_dup_titles_greedy(spark, sf):
    """W6 on page headings: first-wins removal of near-duplicate titles."""
    return ND.greedy_first_wins(page_titles(Tables(spark, sf))).select("id", "kept")


LANG_RE = r"^[a-zA-Z]+://[^/]+/([a-z][a-z])/"


def _harvest_strict_sql(budget: int) -> str:
    dup = ("(list_contains(g.reps, c.rep) OR EXISTS (SELECT 1 FROM pairs p WHERE "
           "(p.id_a = c.rep AND list_contains(g.reps, p.id_b)) OR (p.id_b = c.rep AND list_contains(g.reps, p.id_a))))")
    ok = (f"(g.n < {QU.MAX_TOTAL} AND g.usage < {budget} AND coalesce(g.lists[c.lst], 0) < {QU.MAX_PER_LIST} "
          f"AND coalesce(g.cats[c.cat], 0) < {QU.MAX_PER_CATEGORY} AND g.usage + c.est <= {budget} AND NOT {dup})")
    return f"""
WITH RECURSIVE {_encoded_sql(TITLES_ALL_SQL)},
reps AS (SELECT q.id, r.id AS rep FROM {TITLES_ALL_SQL} q JOIN {_distinct_sql(TITLES_ALL_SQL)} r ON r.text = q.text),
c AS (SELECT row_number() OVER (ORDER BY a.page_id) AS i, a.page_id, a.host AS cat,
             a.host || '|' || regexp_extract(a.url, {q(LANG_RE)}, 1) AS lst, reps.rep,
             ceil(length(a.s) / 4)::BIGINT AS est,
             (ceil(length(a.s) / 4) + ceil(length(t.text) / 4))::BIGINT AS cost
      FROM {ARTICLE_LINES_SQL} a JOIN {TITLES_ALL_SQL} t ON t.id = a.page_id JOIN reps ON reps.id = a.page_id
      WHERE length(a.s) >= 40 AND {strip('t.text')} <> ''),
g(i, usage, n, lists, cats, reps, acc) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, MAP {{}}::MAP(VARCHAR, BIGINT), MAP {{}}::MAP(VARCHAR, BIGINT),
         []::BIGINT[], false
  UNION ALL
  SELECT c.i,
         CASE WHEN {ok} THEN g.usage + c.cost ELSE g.usage END,
         CASE WHEN {ok} THEN g.n + 1 ELSE g.n END,
         CASE WHEN {ok} THEN map_concat(g.lists, MAP {{c.lst: coalesce(g.lists[c.lst], 0) + 1}}) ELSE g.lists END,
         CASE WHEN {ok} THEN map_concat(g.cats, MAP {{c.cat: coalesce(g.cats[c.cat], 0) + 1}}) ELSE g.cats END,
         CASE WHEN {ok} THEN list_append(g.reps, c.rep) ELSE g.reps END,
         {ok}
  FROM g JOIN c ON c.i = g.i + 1
  WHERE g.n < {QU.MAX_TOTAL} AND g.usage < {budget})
SELECT c.page_id, g.usage AS usage_after FROM g JOIN c ON c.i = g.i WHERE g.acc
"""


@register("harvest_strict", _harvest_strict_sql(TIGHT_BUDGET))
def harvest_strict(spark, sf):
    """Strict fold over harvested pages: caps per (host, language) list / host / total,
    a binding token budget, and duplicates by title (identical or ratio > 0.85)."""
    t = Tables(spark, sf)
    titles = page_titles(t)
    copies = ND.exact_copies(titles).withColumnRenamed("id", "page_id").withColumnRenamed("rep_id", "rep")
    pairs = ND.near_duplicate_pairs(titles).select("id_a", "id_b")
    art = page_articles(t)
    cands = (art.join(titles.withColumnRenamed("id", "page_id").withColumnRenamed("text", "title"), "page_id")
             .join(copies, "page_id")
             .where((F.length("article") >= 40) & ~is_blank("title"))
             .select("page_id", F.col("host").alias("category"),
                     F.concat_ws("|", "host", F.regexp_extract("url", LANG_RE, 1)).alias("lst"), "rep",
                     token_estimate("article").alias("est_in"),
                     (token_estimate("article") + token_estimate("title")).cast("long").alias("cost")))
    acc = QU.strict_fold(cands, order="page_id", list_keys=["lst"], category="category", est_in="est_in",
                         cost="cost", budget=TIGHT_BUDGET, dup_pairs=pairs, dup_key="rep")
    return acc.select("page_id", "usage_after")
