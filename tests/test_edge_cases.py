
from pyspark.sql import functions as F

from lectern.functions.text import (ANSWER_MARKER, ANSWER_MARKER_ALT, grade_label, py_strip,
                                    similarity_ratio, strip_diacritics)
from lectern.operators import chunk as CH
from lectern.operators import evaluate as E
from lectern.operators import html as H
from lectern.operators import nested as N
from lectern.operators import prompts as P
from lectern.operators import quota as QU
from lectern.operators import text as X


def _flatten(spark, lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_no long, line string")
    c = N.classify_lines(df)
    docs, quarantine = N.flatten_lectures(c.where("status = 'valid'"), keys=["line_no"])
    return ([r.asDict() for r in docs.orderBy("line_no", "url").collect()],
            [r.asDict() for r in quarantine.collect()],
            {r.line_no: r.status for r in c.collect()})


def test_q1_lecture_only_inside_list(spark):
    docs, _, _ = _flatten(spark, ['{"A":{"lecture_url":"u","content":"c"}}'])
    assert docs == []
    docs, _, _ = _flatten(spark, ['{"A":[{"lecture_url":"u","content":"c"}]}'])
    assert len(docs) == 1 and docs[0]["title"] == "NoTitle" and docs[0]["path"] == "ROOT > A"
    assert docs[0]["url"] == "u" and docs[0]["content"] == "c"


def test_q2_null_content_is_quarantined(spark):
    docs, quarantine, _ = _flatten(spark, ['{"A":[{"lecture_url":"u","content":null}]}'])
    assert docs == [] and len(quarantine) == 1


def test_q3_nested_lists_and_dict_in_list(spark):
    docs, _, _ = _flatten(spark, ['{"A":[[{"lecture_url":"u","content":"c"}],1,"x"]}'])
    assert docs == []
    docs, _, _ = _flatten(spark, ['{"A":[{"B":[{"lecture_url":"u","content":"c"}]}]}'])
    assert [d["path"] for d in docs] == ["ROOT > A > B"]


def test_q18_top_level_list_and_stored_path(spark):
    docs, _, _ = _flatten(spark, ['[{"lecture_url":"u","content":"c"}]',
                                  '{"A":{"S":[{"lecture_url":"v","content":"d","path":"A > S2","title":"t"}]}}'])
    assert [(d["path"], d["title"]) for d in docs] == [("ROOT", "NoTitle"), ("A > S2", "t")]


def test_a1_blank_and_invalid_lines(spark):
    _, _, status = _flatten(spark, ["", "   \t", "not json", '{"A":[]}'])
    assert status == {0: "blank", 1: "blank", 2: "invalid", 3: "valid"}


def test_q5_first_key_in_source_order(spark):
    df = spark.createDataFrame([('{"Z":{},"A":{}}',)], "line string")
    assert N.top_category(df).first()["top_category"] == "Z"


def test_b2_b3_gates(spark):
    df = spark.createDataFrame([('{"lecture_url":"u","content":"c"}',), ('{"lecture_url":"u","content":"c","title":"t"}',)],
                               "obj string").withColumn("v", F.parse_json("obj"))
    r = df.select(N.index_gate(F.col("v")).alias("i"), N.synth_gate(F.col("v")).alias("s")).collect()
    assert [(x.i, x.s) for x in r] == [(True, False), (True, True)]


def test_q6_unicode_strip(spark):
    df = spark.createDataFrame([("\t\n  text  \x1f",)], "t string")
    assert df.select(py_strip(F.col("t")).alias("s")).first().s == "text"


def test_q7_completion_cleanup(spark):
    rows = [('```json{"question": "q", "answer": "' + "a" * 45 + '", "confidence": 90}```',), ("json no",)]
    r = X.parse_completion(spark.createDataFrame(rows, "raw string")).collect()
    assert r[0].status == "ok" and r[0].question == "q" and r[0].confidence == "90"
    assert r[1].payload == " " and r[1].status == "invalid_json"


def test_q8_ratio_edges(spark):
    df = spark.createDataFrame([("", ""), ("a" * 20, "a" * 17 + "bcd")], "a string, b string")
    r = df.select(similarity_ratio("a", "b").alias("r")).collect()
    assert r[0].r is None                     # two empty questions: no error, not a duplicate
    assert abs(r[1].r - 0.85) < 1e-12 and not r[1].r > 0.85


def test_q10_grade_labels(spark):
    rows = [("CORRECT",), ("INCORRECT",), ("correct",), ("CORRECT or INCORRECT",), ("",), (None,)]
    r = spark.createDataFrame(rows, "t string").select(grade_label("t").alias("g")).collect()
    assert [x.g for x in r] == ["CORRECT", "INCORRECT", "UNKNOWN", "INCORRECT", "UNKNOWN", "UNKNOWN"]


def test_q13_pagination_cycle_terminates(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, None)], "node long, next long")
    starts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "chain string, node long")
    r = H.walk_chains(nodes, starts).orderBy("chain", "step").collect()
    assert [(x.chain, x.step, x.node) for x in r] == [("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("c", 0, 4)]


def test_q13_cycle_entered_by_many_chains(spark):
    n = 40                                                        # a tail 0..9 into a cycle 10..39
    nodes = spark.createDataFrame([(i, i + 1 if i < n - 1 else 10) for i in range(n)], "node long, next long")
    starts = spark.createDataFrame([(c, c) for c in range(0, n, 3)], "chain long, node long")
    want = set()
    for c in range(0, n, 3):
        at, step, seen = c, 0, set()
        while at not in seen:
            seen.add(at)
            want.add((c, step, at))
            at, step = (at + 1 if at < n - 1 else 10), step + 1
    r = H.walk_chains(nodes, starts).collect()
    assert len(r) == len(want) and {(x.chain, x.step, x.node) for x in r} == want


def test_b9_anchor_forms(spark):
    html = ("<a\n class='x' href=\"/one\">first\nline</a><A HREF='/two'>second</A><a data-href=\"/no\" href = \"/three\">third</a >"
            "<a name=\"plain\">no address</a><a href=\"/four\"><b>fourth</b></a>")
    pages = H.clean_pages(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string"))
    r = H.link_rows(pages).orderBy("link_no").collect()
    assert [(x.href, x.title) for x in r] == [("/one", "first\nline"), ("/two", "second"), ("/three", "third"), ("/four", "fourth")]


def test_q14_q15_budget_greedy_with_skip(spark):
    c = spark.createDataFrame([(1, 60, 60), (2, 50, 50), (3, 30, 30)], "ord long, est long, cost long")
    r = QU.token_budget(c, order="ord", est_in="est", cost="cost", budget=100).orderBy("ord").collect()
    assert [(x.ord, x.usage_after) for x in r] == [(1, 60), (3, 90)]


def test_q14_invalid_rows_use_no_quota(spark):
    rows = [(1, "L", "C", False), (2, "L", "C", True), (3, "L", "C", True), (4, "L", "C", True)]
    c = spark.createDataFrame(rows, "ord long, lst string, cat string, valid boolean").where("valid")
    r = QU.apply_quotas(c, list_keys=["lst"], category="cat", order="ord").collect()
    assert sorted(x.ord for x in r) == [2, 3]


def test_q21_marker_split(spark):
    m1, m2 = ANSWER_MARKER, ANSWER_MARKER_ALT
    rows = [(f"q {m1}: a",), (f"q {m1} a {m1} b",), (f"q {m2} a",), ("full text",)]
    r = X.marker_split(spark.createDataFrame(rows, "text string")).collect()
    assert [(x.question, x.answer) for x in r] == [
        ("q", ": a"), ("q", f"a {m1} b"), ("q", "a"), ("full text", "full text")]


def test_b19_min_answer_length(spark):
    df = spark.createDataFrame([("x" * 39,), ("x" * 40,)], "answer string")
    assert [len(r.answer) for r in X.min_answer_length(df).collect()] == [40]


def test_b20_chunk_edges():
    assert CH.split_spans("a" * 8096) == [(0, 8096)]
    assert len(CH.split_spans("a " * 4048 + "b")) == 2
    word = "x" * 20000
    spans = CH.split_spans(word)
    assert all(b - a <= 8096 for a, b in spans) and spans[0] == (0, 8096)
    md = "intro\n# Head one\n" + "p " * 3000 + "\n# Head two\n" + "q " * 3000
    spans = CH.split_spans(md)
    assert md[spans[1][0]:].startswith("# Head two")


def test_q11_chunk_before_diacritic_strip(spark):
    text = "كتابُ " * 2000          # 12,000 chars with diacritics
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ch = CH.chunk_documents(df, keep=["doc_id"]).withColumn("stripped", strip_diacritics(F.col("chunk")))
    rows = ch.orderBy("chunk_no").collect()
    assert [len(r.chunk) <= 8096 for r in rows] == [True, True]
    assert len(rows[0].stripped) < len(rows[0].chunk)


def test_g3_empty_dataset_accuracy_zero(spark):
    scored = spark.createDataFrame([("A", "CORRECT")], "dataset string, model_score string")
    names = spark.createDataFrame([("A",), ("B",)], "dataset string")
    r = {x.dataset: x for x in E.dataset_summary(scored, datasets=names).collect()}
    assert r["B"].total == 0 and r["B"].accuracy == 0.0 and r["A"].accuracy == 1.0


def test_c2_placeholder_text_in_question_kept(spark):
    qs = spark.createDataFrame([(1, "what is {context}?")], "item_id long, question string")
    ctx = spark.createDataFrame([(1, 1, "CTX")], "item_id long, n_docs long, context string")
    up = P.prompt_table(qs, ctx).first().user_prompt
    assert "what is {context}?" in up and "CTX" in up


def test_html_entities_and_script(spark):
    html = '<script>var t="</p>";</script><article><p>a &amp;lt; b</p><p> </p><p>c&nbsp;</p></article>'
    p = H.clean_pages(spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string"))
    r = H.paragraphs(p).first()
    assert r.paragraphs == "a &lt; b\nc"


EDGE_LINES = ['{"A":{"lecture_url":"u","content":"c"}}', '{"A":[{"lecture_url":"u1","content":"c"}]}',
              '{"A":[{"lecture_url":"u2","content":null}]}', '{"A":[[{"lecture_url":"u3","content":"c"}],1,"x"]}',
              '{"A":[{"B":[{"lecture_url":"u4","content":"c"}]}]}', '[{"lecture_url":"u5","content":"c"}]',
              '{"A":{"S":[{"lecture_url":"u6","content":"d","path":"A > S2","title":"t"}]}}', "", "not json"]


def test_ordered_mode_equals_variant_mode_on_edges(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(EDGE_LINES)], "line_no long, line string")
    c = N.classify_lines(df)
    docs, quarantine = N.flatten_lectures(c.where("status = 'valid'"), keys=["line_no"])
    ordered = N.flatten_lectures_ordered(df, keys=["line_no"]).collect()
    got = {(r.line_no, r.title, r.url, r.path, r.content) for r in ordered if r.status == "ok"}
    want = {(r.line_no, r.title, r.url, r.path, r.content) for r in docs.collect()}
    assert got == want
    assert [r.line_no for r in ordered if r.status == "quarantine"] == [r.line_no for r in quarantine.collect()]
    assert [r.line_no for r in ordered if r.status == "invalid"] == [8]


def test_ordered_mode_keeps_insertion_order_and_last_duplicate(spark):
    line = '{"Z":[{"lecture_url":"z","content":"1"}],"A":[{"lecture_url":"a","content":"2"},{"lecture_url":"b","content":"3"}],"Z":[{"lecture_url":"z2","content":"4"}]}'
    df = spark.createDataFrame([(0, line)], "line_no long, line string")
    r = N.flatten_lectures_ordered(df, keys=["line_no"]).orderBy("item_no").collect()
    assert [(x.item_no, x.url) for x in r] == [(0, "z2"), (1, "a"), (2, "b")]


def test_q4_q5_q16_synthesis_mode(spark):
    line = ('{"Cat":{"S1":[{"lecture_url":"a","content":"1","title":"t"},'
            '{"Sub":[{"lecture_url":"b","content":"2","title":"t"}]},'
            '{"lecture_url":"c","content":"3"}],'
            '"S2":[{"lecture_url":"d","content":"4","title":"t"}]},"Other":[{"lecture_url":"e","content":"5","title":"t"}]}')
    df = spark.createDataFrame([(0, line), (1, "[1, 2]")], "line_no long, line string")
    r = N.flatten_lectures_ordered(df, keys=["line_no"], mode="synthesis").orderBy("line_no", "item_no").collect()
    ok = [(x.url, x.walk_path, x.list_ord) for x in r if x.status == "ok"]
    # only the first key; paths start at the category; "c" lacks a title; the nested list
    # (S1 > Sub) is finished before its parent list S1
    assert ok == [("a", "Cat > S1", 1), ("b", "Cat > S1 > Sub", 0), ("d", "Cat > S2", 2)]
    assert [x.line_no for x in r if x.status == "quarantine"] == [1]


def test_q19_completion_not_object_or_missing_fields(spark):
    long = "a" * 50
    rows = [('["q", "a"]',), (f'{{"answer": "{long}"}}',), ('{"question": "q", "answer": 7}',),
            (f'{{"question": "q", "answer": ["{long}"]}}',), (f'{{"question": null, "answer": "{long}"}}',), ('{"question": "q"}',)]
    r = X.parse_completion(spark.createDataFrame(rows, "raw string")).collect()
    assert r[0].status == "not_object"
    assert r[1].status == "missing_question" and r[1].answer == long
    assert r[2].status == "answer_not_text" and r[2].answer is None
    assert r[3].status == "answer_not_text"
    assert r[4].status == "ok" and r[4].question is None          # the key is there
    assert r[5].status == "short_answer"


def test_b23_sources_absent_and_repeated(spark):
    rows = [("plain answer",), ("body SOURCES: doc/1, https://x.org/a SOURCES: doc/2",)]
    r = X.cited_sources(spark.createDataFrame(rows, "model_answer string")).collect()
    assert r[0].answer_body == "plain answer" and r[0].cited == []
    assert r[1].answer_body == "body" and r[1].cited == ["doc/1", "https://x.org/a", "doc/2"]


def test_w8_pairs_need_adjacent_turns(spark):
    from lectern.operators import chat as C
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
            (1, 3, "user", "q2"), (1, 4, "system", "x"), (1, 5, "assistant", "a2"), (1, 6, "user", "q3")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = [(r.turn, r.question, r.answer) for r in C.chat_pairs(conv).orderBy("turn").collect()]
    assert pairs == [(1, "q1", "a1")]
    hist = {r.turn: (r.n_pairs, r.history_text) for r in C.history_window(conv).collect()}
    assert hist[1] == (0, "") and hist[3] == (1, "User: q1\nBot: a1") and hist[6][0] == 1


def test_b1_one_pass_any_depth_and_lenient_lines(spark):
    lec = '{"lecture_url":"u","content":"c"}'
    deep = '{"k":' * 200 + f"[{lec}]" + "}" * 200
    docs, quarantine, status = _flatten(spark, [deep, '{"A":[{"lecture_url":"u","content":"old","content":"new"}]}',
                                                '{"x":NaN,"A":[%s]}' % lec, '{"A":[{"lecture_url":"u","content":"\\ud800x"}]}', "{"])
    assert status == {0: "valid", 1: "valid", 2: "valid", 3: "valid", 4: "invalid"}
    assert [(d["line_no"], d["content"]) for d in docs] == [(0, "c"), (1, "new"), (2, "c"), (3, "\ufffdx")]
    assert docs[0]["walk_path"] == "ROOT" + " > k" * 200 and quarantine == []


def test_b1_keeps_partitions_and_returns_invalid_lines(spark):
    df = spark.createDataFrame([(i, '{"A":[{"lecture_url":"u","content":1}]}' if i else "nope") for i in range(4)],
                               "line_no long, line string").repartition(3)
    docs, quarantine = N.flatten_lectures(df, keys=["line_no"])
    assert docs.rdd.getNumPartitions() == 3 and docs.count() == 0
    assert [(r.line_no, r.raw) for r in quarantine.orderBy("line_no").collect()] == [
        (0, "nope"), *[(i, '{"lecture_url": "u", "content": 1}') for i in (1, 2, 3)]]
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1  # the test's own repartition


def test_b1_long_line(spark):
    line = F.concat(F.lit('{"A":[{"lecture_url":"u","content":"'), F.repeat(F.lit("x"), 60_000_000), F.lit('"}]}'))
    docs, _ = N.flatten_lectures(spark.range(1).select(line.alias("line")))
    assert [r.n for r in docs.select(F.length("content").alias("n")).collect()] == [60_000_000]
