"""Archived web pages -> links, section text, paragraphs, pagination walks.

Pages are ``(page_id, url, html)``.  Extraction is regex-based over flat markup
(JVM built-ins, no per-row Python; ``markup`` walks nested markup).  The pagination walk
follows ``next`` pointers with pointer doubling: ``log2(longest chain)`` self-join rounds
instead of one round per page, with a visited guard so cycles terminate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.html import (CONTENT_NOT_FOUND, LINK_RE, PARAGRAPH_RE, element_inner, remove_noise,
                                    text_nodes)
from lectern.functions.text import is_blank
from lectern.session import cut_lineage

HOST_RE = r"^[a-zA-Z]+://([^/?#]+)"


def host_of(url):
    return F.regexp_extract(url, HOST_RE, 1)


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Drop scripts, styles and comments once; later extractions read ``clean``."""
    return pages.withColumn("clean", remove_noise(F.col(html)))


def link_rows(pages: DataFrame) -> DataFrame:
    """One row per ``<a href>`` in page order with nonblank href and title.

    Returns (page_id, url, link_no, href, title); ``pages`` must have ``clean``.
    """
    hrefs = F.regexp_extract_all("clean", F.lit(LINK_RE), 1)
    inner = F.regexp_extract_all("clean", F.lit(LINK_RE), 2)
    z = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("h"), inner.alias("t"))))
    out = z.select("page_id", "url", F.col("pos").cast("long").alias("link_no"),
                   F.substr("col.h", F.lit(2), F.length("col.h") - 2).alias("href"), text_nodes(F.col("col.t"), "").alias("title"))
    return out.where(~is_blank("href") & ~is_blank("title"))


def link_prefix(links: DataFrame, prefix: str) -> DataFrame:
    """Keep links whose href starts with ``prefix``."""
    return links.where(F.col("href").startswith(prefix))


def first_links_per_category(links: DataFrame, n: int, *, category: str = "category",
                             order=("step", "link_no")) -> DataFrame:
    """First ``n`` links per category in walk order (WindowGroupLimit)."""
    w = Window.partitionBy(category).orderBy(*order)
    return links.withColumn("link_rank", F.row_number().over(w)).where(F.col("link_rank") <= n)


def section_text(pages: DataFrame, open_re: str, tag: str, sep: str, *, fallback: str | None = "",
                 out: str = "section_text") -> DataFrame:
    """Text of the first matching element (text nodes, stripped,
    blanks dropped, joined by ``sep``); ``fallback`` when the element is absent."""
    frag = element_inner(F.col("clean"), open_re, tag)
    txt = text_nodes(frag, sep)
    if fallback is not None:
        txt = F.coalesce(txt, F.lit(fallback))
    return pages.withColumn(out, txt)


def lecture_text(pages: DataFrame, out: str = "lecture_text") -> DataFrame:
    """B11 + B14: article text joined with '' or the not-found sentence."""
    return section_text(pages, "<article[^>]*>", "article", "", fallback=CONTENT_NOT_FOUND, out=out)


def paragraphs(pages: DataFrame, *, within_open: str = "<article[^>]*>", within_tag: str = "article",
               out: str = "paragraphs") -> DataFrame:
    """Each ``<p>``'s text (flat form: up to the next ``</p>``), nonblank, joined by newline."""
    scope = F.coalesce(element_inner(F.col("clean"), within_open, within_tag), F.lit(""))
    ps = F.regexp_extract_all(scope, F.lit(PARAGRAPH_RE), 1)
    texts = F.filter(F.transform(ps, lambda p: text_nodes(p, "")), lambda x: x != F.lit(""))
    return pages.withColumn(out, F.array_join(texts, "\n"))


# --------------------------------------------------------------------------- J7
def walk_chains(nodes: DataFrame, starts: DataFrame, *, max_steps: int | None = None) -> DataFrame:
    """Follow ``next`` pointers from each start until none, a self link or a revisit.

    ``nodes``: (node, next); ``starts``: (chain, node).  Returns (chain, step,
    node): every node reached, once, with its first step number, below ``max_steps`` if given.

    Pointer doubling: with the table of jumps of 2^k steps, the nodes reached in
    fewer than 2^k steps give those of fewer than 2^(k+1), and the table
    joined with itself gives the next one, whose predecessor is dropped.  Rounds end when one
    adds no node to any chain, so their number follows the longest walk, not the
    archive.  Each round keeps the first step of a (chain, node), so a cycle never
    multiplies rows (what follows a later visit also follows the first one, at lower steps).
    """
    jump = cut_lineage(nodes.select("node", F.when(F.col("next") != F.col("node"), F.col("next")).alias("j")).where("j is not null"))
    seg = cut_lineage(starts.select("chain", "node", F.lit(0).cast("long").alias("step")))
    reach, n = 1, seg.count()
    while max_steps is None or reach < max_steps:
        ahead = seg.join(jump, "node").select("chain", F.col("j").alias("node"), (F.col("step") + F.lit(reach)).alias("step"))
        seg = cut_lineage(seg.unionByName(ahead).groupBy("chain", "node").agg(F.min("step").alias("step")))
        now = seg.count()
        if now == n:
            break
        n, reach = now, 2 * reach
        further = jump.select(F.col("node").alias("j"), F.col("j").alias("_to"))
        jump = cut_lineage(jump.join(further, "j").select("node", F.col("_to").alias("j")))
    return seg.where(F.col("step") < max_steps) if max_steps else seg
