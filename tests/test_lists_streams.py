"""Input lists, transcripts, and the streams with bounded or unordered input, with failures in the middle."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import cells as X
from lectern.operators import lists as L
from lectern.operators import nested as N
from lectern.operators import text as TX
from lectern.operators import transcript as TR
from lectern.operators.embed import term_embedder
from lectern.plans.io import scratch
from lectern.streaming import stateful as S


def lectures(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, category string, section string, content string")
    t = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    return df.select("*", t.alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), t.alias("lecture_title"),
                     F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("lecture_url"), F.concat_ws(" > ", "category", "section").alias("path"))


def test_ordinals_do_not_depend_on_the_ids(spark):
    shape = [("b", "s2"), ("a", "s1"), ("b", "s1"), ("b", "s2"), ("a", "s1"), (None, "s1"), ("b", None), ("a", "s9"), ("b", "s2")]
    want = None
    for ids in (range(9), [i * 10 ** 15 for i in range(9)], [-(10 ** 17) + i * i for i in range(9)]):
        rows = [(d, c, s, "x") for d, (c, s) in zip(ids, shape)]
        got = [(r.category, r.section, r.line_no, r.list_ord, r.item_no) for r in L.number_lists(lectures(spark, rows)).orderBy("doc_id").collect()]
        assert got == (want or got)
        want = got
    assert want == [("b", "s2", 0, 0, 0), ("a", "s1", 1, 0, 0), ("b", "s1", 0, 1, 0), ("b", "s2", 0, 0, 1), ("a", "s1", 1, 0, 1),
                    (None, "s1", 2, 0, 0), ("b", None, 0, 2, 0), ("a", "s9", 1, 1, 0), ("b", "s2", 0, 0, 2)]


def test_segments_are_bounded_and_add_up(spark):
    rows = [(i * 10 ** 14, "c", "hot" if i % 9 else "cold", "é" * (i % 50)) for i in range(400)]
    numbered = L.number_lists(lectures(spark, rows))
    segs = L.section_segments(numbered, limit=1000).orderBy("list_ord", "seg_no").collect()
    assert max(len(s.text.encode()) for s in segs) < 1000 + 200 and len(segs) > 20
    for section in ("hot", "cold"):
        text = "".join(f"\nTitle: t{d}\nURL: u{d}\n{x}\n" for d, _, s, x in rows if s == section)
        assert "".join(s.text for s in segs if s.section == section) == text
    assert L.section_segments(numbered.where("false")).count() == 0


def test_category_lines_round_trip(spark):
    rows = [(i, "cat" if i % 3 else "dog", f"s{i % 5}", "text \" \n é" * (i % 7)) for i in range(200)]
    lines = L.category_lines(L.number_lists(lectures(spark, rows)), limit=3000)
    assert lines.groupBy("line_no").count().agg(F.max("count")).first()[0] > 2
    assert lines.agg(F.max(F.octet_length("line"))).first()[0] < 3000 * 3
    docs, bad = N.flatten_lectures(lines, keys=["line_no", "part_no"])
    assert bad.count() == 0 and sorted((r.title, r.content) for r in docs.collect()) == sorted((f"t{i}", x) for i, _, _, x in rows)
    whole = L.category_lines(L.number_lists(lectures(spark, rows)))
    assert whole.count() == 2


def test_completion_references(spark):
    made = ['{"question":"q","answer":"%s","references":["a",1,{"b":2}]}', '{"question":"q","answer":"%s","references":"one"}', '{"question":"q","answer":"%s","references":7}',
            '```json{"question":"q","answer":"%s","references":null}```', '{"question":"q","answer":"%s"}', 'no json', '{"answer":"short"}']
    df = spark.createDataFrame([(i, m.replace("%s", "x" * 50), 3, 4) for i, m in enumerate(made)], "i long, raw string, input_tokens long, output_tokens long")
    parsed = TX.parse_completion(df)
    assert [r.references for r in parsed.orderBy("i").collect()] == [["a", "1", '{"b":2}'], ["one"], [], [], [], [], []]
    recs = TX.completion_records(parsed, category=F.lit("c"), question_type=F.lit("General"), sources=F.array(F.lit("s"))).collect()
    assert len(recs) == 5 and all(tuple(r.token_usage) == (3, 4) and r.source_lectures == ["s"] for r in recs)


def test_one_long_conversation_needs_linear_space(spark):
    n = 6000
    conv = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), F.col("id").cast("string")).alias("text"))
    o = TR.turn_offsets(conv)
    segs = TR.transcript_segments(o, limit=4096)
    pairs = [f"User: said {i}\nBot: said {i + 1}" for i in range(0, n, 2)]
    whole = "\n".join(pairs)
    assert segs.agg(F.sum(F.length("text"))).first()[0] == len(whole) - (segs.count() - 1)
    wanted = o.where("turn in (0, 2, 3000, 5998)")
    got = {r.turn: r.history_text for r in TR.histories(wanted, segs).collect()}
    assert got == {t: "\n".join(pairs[:t // 2]) for t in (0, 2, 3000, 5998)}


def test_index_batches_are_all_or_nothing(spark):
    path = scratch(spark, "stream-index")

    def lines(*texts):
        good = [N.json.dumps({"c": {"s": [{"lecture_title": t, "lecture_url": t, "content": t, "title": t} for t in texts]}})]
        return spark.createDataFrame([(x,) for x in [*good, "not json"]], "line string")

    def broken(batch):
        raise RuntimeError("provider down")
    with pytest.raises(Exception):  # after the quarantine is written, before the chunks
        S.index_micro_batch(lines("a b", "c d"), path, "stream-0", lambda b: broken(b), cells=2)
    assert X.committed(spark, path) == []
    embedder = term_embedder(8)
    assert S.index_micro_batch(lines("a b", "c d"), path, "stream-0", embedder, cells=2) == 2
    assert S.index_micro_batch(lines("other", "rows", "x"), path, "stream-0", embedder) == 0  # a replay of a visible batch
    with pytest.raises(Exception):
        S.index_micro_batch(lines("e f"), path, "stream-1", lambda b: broken(b))
    assert X.read_index(spark, path).count() == 2 and S.read_quarantine(spark, path).count() == 1
    assert S.index_micro_batch(lines("e f g"), path, "stream-1", embedder) == 1
    assert sorted(r.text for r in X.read_index(spark, path).collect()) == ["a b", "c d", "e f g"] and S.read_quarantine(spark, path).count() == 2


def test_index_that_starts_empty(spark):
    path = scratch(spark, "cells")
    schema = "doc_id long, chunk_no long, text string, vec array<double>"
    X.write_index(spark.createDataFrame([], schema), path, batch="a")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    assert X.search(spark, path, q, 2).count() == 0
    assert X.write_index(spark.createDataFrame([(i, 0, "t", [float(i), 1.0]) for i in range(5)], schema), path, batch="b") == 5
    assert [r.doc_id for r in X.search(spark, path, q, 2).orderBy("rank").collect()] == [1, 0]


def test_stream_input_is_dealt_over_files(spark):
    """Each part of a stream's input is written by as many tasks as it has; the parts are still micro-batches of their own number."""
    from pyspark.sql import DataFrameWriter

    from lectern.plans.streaming import _deal
    base = scratch(spark, "deal")
    part = lambda lo, hi, n: spark.range(lo, hi, 1, n).select(F.col("id").cast("string").alias("line"))
    files = _deal([part(0, 30, 3), part(30, 50, 2)], DataFrameWriter.text, base + "/src")
    assert files == 3 and len(spark.read.text(base + "/src").inputFiles()) == 5
    met = []
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(base + "/src")
    run = stream.writeStream.foreachBatch(lambda b, i: met.append(sorted(int(r.value) for r in b.collect())))
    run.option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert met == [list(range(30)), list(range(30, 50))]


def test_category_lines_shuffle_texts_once_for_both_groupings(spark):
    rows = [(i, "ab"[i % 2], f"s{i % 3}", f"content {i}") for i in range(40)]
    plan = L.category_lines(L.number_lists(lectures(spark, rows)), limit=200)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(category" in x and "line_no" in x]
    assert len(dealt) == 1 and "part_no" in dealt[0] and "section" not in dealt[0].split("hashpartitioning")[1]
    texts = plan.split("Exchange hashpartitioning(category")[1]
    assert not re.search(r"SortMergeJoin \[coalesce\(category[^\]]*section", texts) and "BroadcastHashJoin [line_no" in texts
