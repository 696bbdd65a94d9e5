"""Nested markup by balance, ancestor conditions, next links, walks; ranges of an order column and the budget over them."""

import random

from pyspark.sql import functions as F

from lectern.operators import html as H
from lectern.operators import markup as M
from lectern.operators import ordered as O
from lectern.operators import quota as QU

PAGE = """<!DOCTYPE html><html><body><nav>menu</nav><section class="q big"><div>Outer &amp; <p>first <b>bold</b></p><div>in&eacute; <p>deep</p></div></div>
<script>var a = "</section>";</script><!-- </section> <p>no</p> --><p>open <p>twice</section><section class="q"><p>second</p></section>
<div class="content"><p>x</div></p><p>tail<br>end<img src="a>b"></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://h.example/list/{i}?x=1#f", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_elements_by_balance(spark):
    p = pages(spark, PAGE, None, "", "plain text", "</p></div>x<p>")
    got = M.select(p, [M.Step(("section",))], sep="|").collect()
    assert [(r.page_id, r.element_no, r.text) for r in got] == [(0, 0, "Outer &|first|bold|iné|deep|open|twice"), (0, 1, "second")]
    assert got[0].attrs == {"class": "q big"} and got[0].url.startswith("https://h.example/list/0")
    inside = M.joined_texts(p, [M.Step(("div", "p"))], within=[M.Step(("section",), ("q",))])
    assert {r.page_id: r.text for r in inside.collect()} == {
        0: "\n".join(["Outer &firstboldinédeep", "firstbold", "inédeep", "deep", "opentwice", "twice"]), 1: "", 2: "", 3: "", 4: ""}
    assert [r.text for r in M.select(p, [M.Step(classes=("content",)), M.Step(("p",))]).collect()] == ["x"]
    assert [r.text for r in M.select(p, [M.Step(("body",)), M.Step(("p",), child=True)], sep="|").collect()] == ["tail|end"]
    assert [r.text for r in M.select(p, [M.Step(("section",), ("big",)), M.Step(("div",), child=True), M.Step(("div",), child=True)]).collect()] == ["inédeep"]
    assert M.select(p, [M.Step(("img",))], first=True).first().attrs == {"src": "a>b"}
    assert M.select(p.where("false"), [M.Step()]).count() == 0


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    long = "<article>" + "<p>word <i>more</i></p>" * 50_000 + "</article>"
    got = M.select(pages(spark, deep, long), [M.Step(("article", "i"))], first=True).collect()
    assert len(got) == 1 and len(got[0].text) == 50_000 * 8
    assert M.select(pages(spark, deep), [M.Step(("div",))]).agg(F.count("*"), F.min("text")).first() == (5000, "core")


def test_next_links(spark):
    link = '<ul><li class="prev"><a rel="prev" href="/0">a</a></li><li class="item next">{}</li></ul>'
    made = [link.format(f'<a rel="next" href="{h}">n</a>') for h in ("https://o.example/9", "//o.example/8#z", "/list/7", "6", "?p=2", " ", "#top")]
    made += ["<p>none</p>", link.format('<b><a rel="next" href="/deep">n</a></b>'), '<li class="the-next-page"><span><a href="/plain">n</a></span></li>', None]
    p = pages(spark, *made)
    got = {r.page_id: r.next_url for r in M.next_links(p, M.NEXT_LINKS[0]).collect()}
    assert got == {0: "https://o.example/9", 1: "https://o.example/8", 2: "https://h.example/list/7", 3: "https://h.example/list/6", 4: "https://h.example/list/4?p=2",
                   5: None, 6: "https://h.example/list/6?x=1#f", 7: None, 8: None, 9: None, 10: None}
    assert {r.page_id: r.next_url for r in M.next_links(p, M.NEXT_LINKS[1]).collect()}[9] == "https://h.example/plain"


def test_walks_against_stepping(spark):
    rnd = random.Random(2)
    nxt = {i: rnd.choice([None, i, *range(60)]) if rnd.random() < 0.3 else i + 1 for i in range(60)}
    nodes = spark.createDataFrame([(i, j) for i, j in nxt.items() if j is None or j < 60], "node long, next long")
    starts = [0, 7, 20, 41, 41, 59]
    want = set()
    for s in starts:
        at, step, seen = s, 0, set()
        while at is not None and at < 60 and at not in seen:
            want.add((s, step, at))
            seen.add(at)
            at, step = (nxt[at] if nxt[at] != at else None), step + 1
    got = H.walk_chains(nodes, spark.createDataFrame([(s, s) for s in starts], "chain long, node long"))
    assert {tuple(r) for r in got.select("chain", "step", "node").collect()} == want and got.count() == len(want)
    some = H.walk_chains(nodes, spark.createDataFrame([(0, 0)], "chain long, node long"), max_steps=5)
    assert {tuple(r) for r in some.select("chain", "step", "node").collect()} == {w for w in want if w[0] == 0 and w[1] < 5}


def test_ranges_of_sparse_and_skewed_ids(spark):
    rnd = random.Random(4)
    ids = [rnd.getrandbits(62) * rnd.choice((1, -1)) for _ in range(3000)] + list(range(3000)) + [5] * 400
    df = spark.createDataFrame([(i, 1 + n % 7) for n, i in enumerate(ids)] + [(None, 9)], "o long, v long")
    b = O.range_buckets(df, "o", rows=256)
    per = {r["_bucket"]: (r.n, r.lo, r.hi) for r in b.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi")).collect()}
    assert per.pop(None)[0] == 1 and sum(n for n, *_ in per.values()) == 6400 and len(per) > 15
    assert max(n for n, *_ in per.values()) <= 400 + 600
    spans = [(lo, hi) for _, (_, lo, hi) in sorted(per.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    unique = spark.createDataFrame([(i, 1 + i % 7) for i in set(ids)], "o long, v long")
    got = {r.o: r.s for r in O.running_sum(unique, order="o", value="v", out="s", bucket_width=200).collect()}
    total, want = 0, {}
    for i in sorted(set(ids)):
        want[i], total = total, total + 1 + i % 7
    assert got == want
    ranked, n = O.rank_rows(unique, F.desc("v"), F.asc("o"))
    assert n == len(want) and [r.o for r in ranked.orderBy("rank").collect()] == sorted(want, key=lambda i: (-(1 + i % 7), i))


def test_budget_over_ranges_equals_the_fold(spark):
    rnd = random.Random(9)
    for budget, width in ((5_000, 16), (40_000, 64), (10 ** 9, 64), (0, 8), (120, 8)):
        rows = [(rnd.getrandbits(60), rnd.randint(0, 200), rnd.randint(0, 40)) for _ in range(700)] + [(1 << 61, budget + 1, 0)]
        usage, want = 0, []
        for o, e, x in sorted(rows):
            if usage < budget and usage + e <= budget:
                usage += e + x
                want.append((o, usage))
        df = spark.createDataFrame([(o, e, e + x, "t") for o, e, x in rows], "ord long, est long, cost long, title string")
        got = QU.token_budget(df, order="ord", est_in="est", cost="cost", budget=budget, bucket_width=width)
        assert got.columns == ["ord", "est", "cost", "title", "usage_after"]
        assert sorted((r.ord, r.usage_after) for r in got.collect()) == want
    assert QU.token_budget(df.where("false"), order="ord", est_in="est", cost="cost").count() == 0
