"""Archived page queries: links, prefix filter, per-category caps, section text,
paragraphs, fallback, pagination walk and harvest yield."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.html import CONTENT_NOT_FOUND, LINK_RE, PARAGRAPH_RE
from lectern.functions.text import is_blank
from lectern.operators import html as H
from lectern.operators.ordered import lead_columns
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import denoise, q, strip, text_nodes
from lectern.functions.fixed import LINKS_PER_CATEGORY

LINK_PREFIX = "/t"      # B10 prefix used by the registered query

CLEAN_SQL = f"(SELECT page_id, url, regexp_extract(url, {q(H.HOST_RE)}, 1) AS host, {denoise('html')} AS clean FROM pages)"
LINKS_SQL = f"""
(SELECT page_id, url, host, i - 1 AS link_no, substr(h[i], 2, length(h[i]) - 2) AS href, {text_nodes('t[i]', '')} AS title
 FROM (SELECT page_id, url, host, h, t, unnest(range(1, len(h) + 1)) AS i
       FROM (SELECT page_id, url, host, regexp_extract_all(clean, {q(LINK_RE)}, 1) AS h,
                    regexp_extract_all(clean, {q(LINK_RE)}, 2) AS t FROM {CLEAN_SQL})))
"""
NONBLANK_LINKS_SQL = f"(SELECT * FROM {LINKS_SQL} WHERE {strip('href')} <> '' AND {strip('title')} <> '')"


def _inner_sql(open_re: str, tag: str) -> str:
    pat = q(f"(?s){open_re}(.*?)</{tag}>")
    return f"CASE WHEN regexp_matches(clean, {pat}) THEN regexp_extract(clean, {pat}, 1) END"


def pages_clean(t: Tables):
    p = t.pages
    return H.clean_pages(p.withColumn("host", H.host_of(F.col("url"))))


@register("link_extract", f"SELECT page_id, link_no, href, title FROM {NONBLANK_LINKS_SQL}")
def link_extract(spark, sf):
    return H.link_rows(pages_clean(Tables(spark, sf))).select("page_id", "link_no", "href", "title")


@register("link_prefix", f"SELECT page_id, link_no, href FROM {NONBLANK_LINKS_SQL} WHERE starts_with(href, {q(LINK_PREFIX)})")
def link_prefix(spark, sf):
    links = H.link_rows(pages_clean(Tables(spark, sf)))
    return H.link_prefix(links, LINK_PREFIX).select("page_id", "link_no", "href")


@register("links_per_category", f"""
SELECT host AS category, page_id, link_no, href,
       row_number() OVER (PARTITION BY host ORDER BY page_id, link_no) AS link_rank
FROM {NONBLANK_LINKS_SQL} WHERE starts_with(href, {q(LINK_PREFIX)})
QUALIFY link_rank <= {LINKS_PER_CATEGORY}
""")
def links_per_category(spark, sf):
    p = pages_clean(Tables(spark, sf))
    links = H.link_prefix(H.link_rows(p), LINK_PREFIX).withColumn("category", H.host_of(F.col("url")))
    top = H.first_links_per_category(links, LINKS_PER_CATEGORY, order=("page_id", "link_no"))
    return top.select("category", "page_id", "link_no", "href", F.col("link_rank").cast("long").alias("link_rank"))


def _text_cols_sql(expr: str) -> str:
    return f"length({expr}) AS n_chars, md5({expr}) AS text_md5"


@register("page_text_concat", f"""
SELECT page_id, {_text_cols_sql('s')} FROM (SELECT page_id, {text_nodes(_inner_sql('<article[^>]*>', 'article'), '')} AS s FROM {CLEAN_SQL})
""")
def page_text_concat(spark, sf):
    s = H.section_text(pages_clean(Tables(spark, sf)), "<article[^>]*>", "article", "", fallback=None)
    return s.select("page_id", F.length("section_text").alias("n_chars"), F.md5("section_text").alias("text_md5"))


@register("page_text_lines", f"""
SELECT page_id, {_text_cols_sql('s')}, len(string_split(s, chr(10))) AS n_lines
FROM (SELECT page_id, {text_nodes(_inner_sql('<article[^>]*>', 'article'), chr(10))} AS s FROM {CLEAN_SQL})
""")
def page_text_lines(spark, sf):
    s = H.section_text(pages_clean(Tables(spark, sf)), "<article[^>]*>", "article", "\n", fallback=None)
    return s.select("page_id", F.length("section_text").alias("n_chars"), F.md5("section_text").alias("text_md5"),
                    F.size(F.split("section_text", "\n")).alias("n_lines"))


@register("page_paragraphs", f"""
SELECT page_id, {_text_cols_sql('s')} FROM (
  SELECT page_id, array_to_string(list_filter(list_transform(
           regexp_extract_all(coalesce({_inner_sql('<article[^>]*>', 'article')}, ''), {q(PARAGRAPH_RE)}, 1),
           lambda p: {text_nodes('p', '')}), lambda x: x <> ''), chr(10)) AS s
  FROM {CLEAN_SQL})
""")
def page_paragraphs(spark, sf):
    s = H.paragraphs(pages_clean(Tables(spark, sf)))
    return s.select("page_id", F.length("paragraphs").alias("n_chars"), F.md5("paragraphs").alias("text_md5"))


ARTICLE_DROP_RE = r"(?s)<article[^>]*>.*?</article>"


@register("section_fallback", f"""
SELECT page_id, s = {q(CONTENT_NOT_FOUND)} AS is_fallback, {_text_cols_sql('s')} FROM (
  SELECT page_id, coalesce({text_nodes(_inner_sql('<article[^>]*>', 'article'), '')}, {q(CONTENT_NOT_FOUND)}) AS s
  FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_replace(clean, {q(ARTICLE_DROP_RE)}, '', 'g')
                             ELSE clean END AS clean FROM {CLEAN_SQL}))
""")
def section_fallback(spark, sf):
    p = pages_clean(Tables(spark, sf))
    p = p.withColumn("clean", F.when(F.col("page_id") % 4 == 0, F.regexp_replace("clean", ARTICLE_DROP_RE, ""))
                     .otherwise(F.col("clean")))
    s = H.lecture_text(p)
    return s.select("page_id", (F.col("lecture_text") == F.lit(CONTENT_NOT_FOUND)).alias("is_fallback"),
                    F.length("lecture_text").alias("n_chars"), F.md5("lecture_text").alias("text_md5"))


def _page_chain(t: Tables):
    """Pagination graph of the archive: a page's ``next`` is the following page of its host."""
    p = t.pages.select("page_id", H.host_of(F.col("url")).alias("host"))
    return lead_columns(p, keys=["host"], order="page_id", cols=[]).withColumnRenamed("next_page_id", "next")


@register("pagination_walk", f"""
WITH RECURSIVE p AS (SELECT page_id, host, lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS nxt
                     FROM {CLEAN_SQL}),
walk(host, step, page_id) AS (
  SELECT host, 0::BIGINT, min(page_id) FROM p GROUP BY host
  UNION ALL
  SELECT w.host, w.step + 1, p.nxt FROM walk w JOIN p ON p.page_id = w.page_id
  WHERE p.nxt IS NOT NULL AND p.nxt <> p.page_id)
SELECT host, step, page_id FROM walk
""")
def pagination_walk(spark, sf):
    chain = _page_chain(Tables(spark, sf))
    starts = chain.groupBy("host").agg(F.min("page_id").alias("node")).withColumnRenamed("host", "chain")
    longest = chain.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    nodes = chain.select(F.col("page_id").alias("node"), "next")
    walk = H.walk_chains(nodes, starts, max_steps=int(longest))
    return walk.select(F.col("chain").alias("host"), "step", F.col("node").alias("page_id"))


@register("harvest_yield", f"""
WITH top AS (SELECT host, page_id, link_no,
                    row_number() OVER (PARTITION BY host ORDER BY page_id, link_no) AS r
             FROM {NONBLANK_LINKS_SQL} WHERE starts_with(href, {q(LINK_PREFIX)}) QUALIFY r <= {LINKS_PER_CATEGORY}),
     txt AS (SELECT page_id, {text_nodes(_inner_sql('<article[^>]*>', 'article'), chr(10))} AS s FROM {CLEAN_SQL})
SELECT h.host AS category, count(top.host) AS links_found,
       count_if(top.host IS NOT NULL AND txt.s IS NOT NULL AND {strip('txt.s')} <> '') AS records_written
FROM (SELECT DISTINCT host FROM {CLEAN_SQL}) h LEFT JOIN top ON top.host = h.host
LEFT JOIN txt ON txt.page_id = top.page_id GROUP BY h.host
""")
def harvest_yield(spark, sf):
    """Links collected per category vs records that would be written (nonblank text); hosts without links have zeros."""
    p = pages_clean(Tables(spark, sf))
    links = H.link_prefix(H.link_rows(p), LINK_PREFIX).withColumn("category", H.host_of(F.col("url")))
    top = H.first_links_per_category(links, LINKS_PER_CATEGORY, order=("page_id", "link_no"))
    txt = H.section_text(p, "<article[^>]*>", "article", "\n", fallback=None).select("page_id", "section_text")
    j = top.join(txt, "page_id")
    ok = ~is_blank("section_text")
    found = j.groupBy("category").agg(F.count(F.lit(1)).alias("links_found"), F.count_if(ok).alias("records_written"))
    hosts = p.select(F.col("host").alias("category")).distinct()
    return hosts.join(found, "category", "left").na.fill(0, ["links_found", "records_written"])


H1_SQL = f"{text_nodes(_inner_sql('<h1[^>]*>', 'h1'), '')}"
TITLES_ALL_SQL = f"(SELECT page_id AS id, {H1_SQL} AS text FROM {CLEAN_SQL})"


def page_titles(t: Tables):
    """Harvested page headings (text of ``<h1>``): the question titles of an archive."""
    p = H.section_text(pages_clean(t), "<h1[^>]*>", "h1", "", fallback=None, out="text")
    return p.select(F.col("page_id").alias("id"), "text")


ARTICLE_LINES_SQL = (f"(SELECT page_id, url, host, {text_nodes(_inner_sql('<article[^>]*>', 'article'), chr(10))} AS s "
                     f"FROM {CLEAN_SQL})")


def page_articles(t: Tables):
    """(page_id, url, host, article): article text joined by newline."""
    p = H.section_text(pages_clean(t), "<article[^>]*>", "article", "\n", fallback=None, out="article")
    return p.select("page_id", "url", "host", "article")
