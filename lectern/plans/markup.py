"""Queries over nested markup: pages with a balanced block and a next-page link spliced in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.fixed import CONTENT_NOT_FOUND
from lectern.operators import html as H
from lectern.operators import markup as M
from lectern.operators.ordered import lead_columns
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import decode, denoise, q, strip

#: Nested block put at the head of every article (the page's number in the middle).
BLOCK = ('<article class="post"><section class="question"><div>Outer &amp; <p>first <b>bold</b> tail</p><div>inner <p>deep &lt;x&gt; ',
         '</p> rest</div><div><p>only</p></div> after</div></section>')


def spliced(t: Tables) -> DataFrame:
    """Pages at ``https://<host>/list/<page_id>`` with the block and a link to the host's next page.

    By number: no link (5 mod 11), a link back to the host's first page (7 mod 13), to itself (3 mod 17);
    addresses are absolute, rooted or relative by number mod 3.
    """
    p = t.pages.select("page_id", H.host_of(F.col("url")).alias("host"), "html")
    first = p.groupBy("host").agg(F.min("page_id").alias("first"))
    n = lead_columns(p.select("page_id", "host"), keys=["host"], order="page_id", cols=[]).join(first, "host")
    to = F.when(F.col("page_id") % 13 == 7, F.col("first")).when(F.col("page_id") % 17 == 3, F.col("page_id")).otherwise(F.col("next_page_id"))
    n = n.select("page_id", F.when(F.col("page_id") % 11 != 5, to).cast("string").alias("to"))
    site = F.concat(F.lit("https://"), "host")
    href = F.when(F.col("page_id") % 3 == 0, F.concat(site, F.lit("/list/"), "to")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/list/"), "to")).otherwise(F.col("to"))
    link = F.when(F.col("to").isNull(), F.lit("")).otherwise(F.concat(F.lit('<li class="item next"><a rel="next" href="'), href, F.lit('">&raquo;</a></li>')))
    j = p.join(n, "page_id")
    body = F.replace("html", F.lit("<article>"), F.concat(F.lit(BLOCK[0]), F.col("page_id").cast("string"), F.lit(BLOCK[1])))
    nav = F.concat(F.lit('<ul class="pages"><li class="prev"><a rel="prev" href="/list/0">&laquo;</a></li>'), link, F.lit("</ul></footer>"))
    return j.select("page_id", "host", F.concat(site, F.lit("/list/"), F.col("page_id").cast("string")).alias("url"),
                    F.replace(body, F.lit("</footer>"), nav).alias("html"))


_VOID = ", ".join(q(x) for x in sorted(M.VOID))
#: Elements of the spliced articles by a stack of open tags, token by token: no expression of the engine is used.
ELEMENTS = f"""
source AS (
  SELECT page_id, replace({denoise('html')}, '<article>', {q(BLOCK[0])} || page_id || {q(BLOCK[1])}) AS html FROM pages
), token AS (
  SELECT page_id, u.i - 1 AS i, lower(regexp_extract(ps[u.i], '^/?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, starts_with(ps[u.i], '/') AS closes,
         contains(split_part(ps[u.i], '>', 1), 'class="question"') AS question,
         {strip(decode("substr(ps[u.i], strpos(ps[u.i], '>') + 1)"))} AS text
  FROM (SELECT page_id, string_split(html, '<') AS ps FROM source), unnest(range(2, len(ps) + 1)) AS u(i)
), run AS (
  SELECT page_id, 0::BIGINT AS i, []::STRUCT(i BIGINT, tag VARCHAR)[] AS stack, []::STRUCT(i BIGINT, tag VARCHAR)[] AS shut FROM source
  UNION ALL
  SELECT page_id, i, CASE WHEN pos > 0 THEN stack[1:pos - 1] WHEN closes OR tag = '' OR tag IN ({_VOID}) THEN stack ELSE list_append(stack, {{'i': i, 'tag': tag}}) END,
         CASE WHEN pos > 0 THEN stack[pos:] ELSE [] END
  FROM (SELECT r.page_id, t.i, t.tag, t.closes, r.stack,
               CASE WHEN t.closes THEN coalesce(list_max(list_filter(range(1, len(r.stack) + 1), lambda p: r.stack[p].tag = t.tag)), 0) ELSE 0 END AS pos
        FROM run r JOIN token t ON t.page_id = r.page_id AND t.i = r.i + 1)
), element AS (
  SELECT s.page_id, s.x.i AS a, s.x.tag AS tag, s.i AS b FROM (SELECT page_id, i, unnest(shut) AS x FROM run) s
  UNION ALL
  SELECT page_id, x.i, x.tag, i + 1 FROM (SELECT page_id, i, unnest(stack) AS x FROM run r WHERE i = (SELECT max(i) FROM token t WHERE t.page_id = r.page_id))
), part AS (
  SELECT e.page_id, e.a, e.b, e.tag, t.i, t.text FROM element e JOIN token t ON t.page_id = e.page_id AND t.i >= e.a AND t.i < e.b AND t.text <> ''
)"""


@register("page_text_nested", f"""
WITH RECURSIVE {ELEMENTS}
SELECT page_id, string_agg(text, '' ORDER BY i) AS joined, md5(string_agg(text, chr(10) ORDER BY i)) AS lines_md5, count(*) AS n_nodes
FROM part WHERE tag = 'article' GROUP BY page_id
""")
def page_text_nested(spark, sf):
    """The article's text found by balance, joined with nothing and by line feeds."""
    p = spliced(Tables(spark, sf))
    lines = M.select(p, [M.Step(("article",))], sep="\n", first=True, keep=("page_id",)).select("page_id", F.col("text").alias("lines"))
    return lines.select("page_id", F.array_join(F.split("lines", "\n"), "").alias("joined"), F.md5("lines").alias("lines_md5"),
                        F.size(F.split("lines", "\n")).cast("long").alias("n_nodes"))


@register("page_paragraphs_nested", f"""
WITH RECURSIVE {ELEMENTS}, scope AS (
  SELECT e.page_id, min(a) AS a FROM element e JOIN token t ON t.page_id = e.page_id AND t.i = e.a WHERE t.question AND e.tag = 'section' GROUP BY e.page_id
), chosen AS (
  SELECT p.page_id, p.a, string_agg(p.text, '' ORDER BY p.i) AS s
  FROM part p JOIN scope ON scope.page_id = p.page_id JOIN element o ON o.page_id = scope.page_id AND o.a = scope.a
  WHERE p.a > o.a AND p.a < o.b AND p.tag IN ('div', 'p') GROUP BY p.page_id, p.a
)
SELECT page_id, string_agg(s, chr(10) ORDER BY a) AS text FROM chosen GROUP BY page_id
""")
def page_paragraphs_nested(spark, sf):
    """B13 (Q12): texts of every div and p inside the question section; nested ones repeat."""
    return M.joined_texts(spliced(Tables(spark, sf)), [M.Step(("div", "p"))], within=[M.Step(("section",), ("question",))])


@register("page_article_paragraphs", f"""
WITH RECURSIVE {ELEMENTS}, scope AS (
  SELECT page_id, min(a) AS a FROM element WHERE tag = 'article' GROUP BY page_id
), chosen AS (
  SELECT p.page_id, p.a, string_agg(p.text, '' ORDER BY p.i) AS s
  FROM part p JOIN scope ON scope.page_id = p.page_id JOIN element o ON o.page_id = scope.page_id AND o.a = scope.a
  WHERE p.a > o.a AND p.a < o.b AND p.tag = 'p' GROUP BY p.page_id, p.a
)
SELECT page_id, md5(string_agg(s, chr(10) ORDER BY a)) AS text_md5, count(*) AS n_paragraphs FROM chosen GROUP BY page_id
""")
def page_article_paragraphs(spark, sf):
    """B13 on the archive's own markup, whose paragraphs are often left open and so hold the ones behind them."""
    t = M.joined_texts(spliced(Tables(spark, sf)), [M.Step(("p",))], within=[M.Step(("article",))])
    return t.select("page_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).cast("long").alias("n_paragraphs"))


GRAPH = f"""
graph AS (
  SELECT page_id, host, CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 13 = 7 THEN min(page_id) OVER (PARTITION BY host)
                             WHEN page_id % 17 = 3 THEN page_id ELSE lead(page_id) OVER (PARTITION BY host ORDER BY page_id) END AS nxt
  FROM (SELECT page_id, regexp_extract(url, {q(H.HOST_RE)}, 1) AS host FROM pages))"""


@register("next_links", f"""
WITH {GRAPH} SELECT page_id, 'https://' || host || '/list/' || nxt AS next_url FROM graph
""")
def next_links(spark, sf):
    """The next-page link of every page as an absolute address."""
    return M.next_links(spliced(Tables(spark, sf)), M.NEXT_LINKS[0]).select("page_id", "next_url")


@register("next_link_walk", f"""
WITH RECURSIVE {GRAPH}, walk AS (
  SELECT host, 0::BIGINT AS step, min(page_id) AS page_id, [min(page_id)] AS seen FROM graph GROUP BY host
  UNION ALL
  SELECT w.host, step + 1, nxt, list_append(seen, nxt) FROM walk w JOIN graph g ON g.page_id = w.page_id
  WHERE nxt IS NOT NULL AND NOT list_contains(seen, nxt)
)
SELECT host, step, page_id FROM walk
""")
def next_link_walk(spark, sf):
    """Category pages followed from each host's first one over the links in their markup; cycles, self links and dead ends end it."""
    p = spliced(Tables(spark, sf))
    links = M.next_links(p, M.NEXT_LINKS[0])
    known = p.select(F.col("url").alias("next_url"), F.col("page_id").alias("next"))
    nodes = links.join(known, "next_url").select(F.col("page_id").alias("node"), "next")
    starts = p.groupBy("host").agg(F.min("page_id").alias("node")).withColumnRenamed("host", "chain")
    return H.walk_chains(nodes, starts).select(F.col("chain").alias("host"), "step", F.col("node").alias("page_id"))
