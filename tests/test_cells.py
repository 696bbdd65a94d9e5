"""The chunk index: exact with all cells probed, pruned reads, commits; kNN plans without an exchange below the scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cells as X
from lectern.operators.embed import embed, term_embedder
from lectern.operators.vectors import knn_join
from lectern.plans.io import scratch

SCHEMA = "doc_id long, chunk_no long, text string, vec array<double>"


def rows(n=600, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims)) * 4
    return [(i // 3, i % 3, f"text {i}", (centre[i % 12] + rng.normal(size=dims)).tolist()) for i in range(n)]


def nearest(data, q, k):
    d = sorted((round(sum((a - b) ** 2 for a, b in zip(r[3], q)), 9), r[0], r[1]) for r in data)
    return [x[1:] for x in d[:k]]


def nearest_at(data, q, k):
    return sorted(sum((a - b) ** 2 for a, b in zip(r[3], q)) for r in data)[k - 1]


def test_search_is_exact_with_all_cells_and_prunes_with_few(spark):
    data, path = rows(), scratch(spark, "cells")
    df = spark.createDataFrame(data, SCHEMA)
    assert X.write_index(df.where("doc_id % 2 = 0"), path, batch="a", cells=12) + X.write_index(df.where("doc_id % 2 = 1"), path, batch="b") == 600
    qs = [(i, (np.array(data[i * 7][3]) + 0.1).tolist()) for i in range(20)]
    q = spark.createDataFrame(qs, "id long, vec array<double>")
    for limit in (1 << 20, 0):
        for got in (X.search(spark, path, q, 5, limit=limit).collect(), X.search(spark, path, q, 5, probes=12, limit=limit).collect()):
            for i, v in qs:
                assert [(r.doc_id, r.chunk_no) for r in sorted((r for r in got if r.id == i), key=lambda r: r["rank"])] == nearest(data, v, 5)
    with_cells = X._with_cells(q, X.centroids_of(spark, path), 12)
    bound = spark.createDataFrame([(i, nearest_at(data, v, 5)) for i, v in qs], "id long, worst double")
    open_ = X._open_cells(spark, path, with_cells.join(bound, "id"), 2)
    assert (open_.agg(F.sum(F.size("cells"))).first()[0] or 0) < 20 * 5  # clustered vectors: the bound leaves few of the ten other cells
    few = X.search(spark, path, q, 5, probes=2)
    found = {(r.id, r.doc_id, r.chunk_no) for r in few.collect()}
    assert sum(len(found & {(i, *x) for x in nearest(data, v, 5)}) for i, v in qs) >= 0.9 * 100
    assert X.probed_share(spark, path, q, 2) < 0.4
    one = X.search(spark, path, q.limit(1), 5, probes=1)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert set(few.columns) == {"id", "rank", "distance", "doc_id", "chunk_no", "text", "cell"}


def test_writes_are_visible_as_a_whole_and_replays_do_nothing(spark):
    path = scratch(spark, "cells")
    df = spark.createDataFrame(rows(90), SCHEMA)
    X.write_index(df, path, batch="a", cells=4)
    # a write that broke off before its manifest row: files, but nobody sees them
    df.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(f"{path}/chunks/batch=b")
    assert X.read_index(spark, path).count() == 90
    assert X.write_index(df.limit(30), path, batch="b") == 30
    assert X.read_index(spark, path).count() == 120
    assert X.write_index(df, path, batch="b") == 0 and X.read_index(spark, path).count() == 120
    assert X.compact(spark, path, "c") == 120 and X.committed(spark, path) == ["c"]
    assert X.write_index(df.limit(10), path, batch="d", overwrite=True, cells=2) == 10
    assert X.read_index(spark, path).count() == 10 and X.committed(spark, path) == ["d"]


def test_index_of_odd_rows(spark):
    path = scratch(spark, "cells")
    with pytest.raises(ValueError):
        X.read_index(spark, path)
    odd = [(1, 0, "a", [1.0, 0.0]), (1, 1, None, [1.0, 0.0]), (2, 0, "n", None), (3, 0, "x", [1.0]), (4, 0, "y", [None, 1.0]), (None, 0, "z", [0.0, 1.0]), (5, 0, "", [0.0, 1.0])]
    X.write_index(spark.createDataFrame([r for r in odd if r[3] is None or len(r[3]) == 2], SCHEMA), path, batch="a", cells=2)
    X.write_index(spark.createDataFrame(odd, SCHEMA), path, batch="b")
    assert X.read_index(spark, path).count() == 8
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (None, [1.0, 0.0]), (3, [1.0, 2.0, 3.0])], "id long, vec array<double>")
    got = sorted((r.id, r["rank"], r.doc_id, r.chunk_no) for r in X.search(spark, path, q, 3, probes=2).select("id", "rank", "doc_id", "chunk_no").distinct().collect())
    assert got == [(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 1, 1)]
    empty = scratch(spark, "cells")
    X.write_index(spark.createDataFrame([], SCHEMA), empty, batch="a")
    assert X.read_index(spark, empty).count() == 0


def test_one_hot_cell_is_split(spark):
    path = scratch(spark, "cells")
    same = spark.range(4000).select("id", F.lit(0).alias("chunk_no"), F.lit("t" * 200).alias("text"), F.array(*[F.lit(1.0)] * 8).alias("vec")).withColumnRenamed("id", "doc_id")
    assert X.write_index(same, path, batch="a", cells=2) == 4000
    q = spark.createDataFrame([(0, [1.0] * 8)], "id long, vec array<double>")
    assert [r.doc_id for r in X.search(spark, path, q, 4, probes=1).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_no_exchange_below_the_scoring(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    plan = knn_join(df, df, 3, query_id="vec_id", index_id="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[1]


def test_embedding_runs_in_batches_of_the_provider(spark):
    sizes = spark.sparkContext.accumulator(0)
    inner = term_embedder(16)

    def provider(batch):
        assert len(batch) <= 100
        sizes.add(1)
        return inner(batch)
    df = spark.range(0, 950, 1, 2).select("id", F.concat(F.lit("Term term é "), F.col("id").cast("string")).alias("text"))
    out = embed(df, provider).collect()
    assert sizes.value == 10 and len(out) == 950
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-2 and len(r.vec) == 16 for r in out)
    assert embed(spark.createDataFrame([(1, None), (2, "..")], "id long, text string"), term_embedder(4)).collect()[0].vec == [0.0] * 4


def test_text_slices_bound_rows_and_bytes():
    import pyarrow as pa

    from lectern.operators.blocks import text_slices
    texts = ["é" * 10, None, "x" * 900, "", "y" * 40, *["z" * 15] * 20, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": texts})
    parts = list(text_slices(batch, 1, rows=8, size=100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 100 for p in parts)
    assert max(p.num_rows for p in parts) <= 8


def test_broadcast_queries_meet_rows_in_lots(spark):
    """Many broadcast questions: candidates are merged lot by lot, never for all questions at once."""
    import numpy as np

    from lectern.operators import blocks
    from lectern.operators.vectors import CANDIDATES, closest, nearest, ranked
    rng = np.random.default_rng(3)
    side = lambda n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(0, 9, (n, 4)).astype(float))], "id long, vec array<double>")
    q, x = side(90).localCheckpoint(), side(500).localCheckpoint()
    most = spark.sparkContext.accumulator(0)

    def watched(k):
        kernel = nearest(k)

        def fn(a, b):
            most.add(a.num_rows > 21)
            return kernel(a, b)
        return fn
    got = blocks.scan_against(x, q, watched(5), closest(5), CANDIDATES, lot_bytes=2048)
    rows = sorted(map(tuple, ranked(got, 5).collect()))
    whole = blocks.scan_against(x, q, nearest(5), closest(5), CANDIDATES, grid=(1, 1))
    assert rows == sorted(map(tuple, ranked(whole, 5).collect())) and len(rows) == 450
    assert most.value == 0


def test_offline_embedder_remembers_no_pairs():
    import hashlib
    import re

    import pandas as pd
    texts = ["The THE the", "É é ß İ Ω1 a-b_c d", "", "one", None, "x\x00y \x7f 日本 語"]
    provider = term_embedder(32)
    got = provider(pd.DataFrame({"text": texts}))["vec"]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t, vec in zip(texts, got):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
        want = np.zeros(32)
        for a, b in zip(words, words[1:]):
            want[int(hashlib.md5(f"{a} {b}".encode()).hexdigest()[:8], 16) % 32] += 1
        norm = np.sqrt((want * want).sum())
        assert vec.tolist() == (np.floor(want / norm * 4096 + 0.5) / 4096 if norm else want).tolist()

    def held(fn):
        cells = [c.cell_contents for c in fn.__closure__ or ()]
        return [c for c in cells if isinstance(c, dict)] + [d for c in cells if callable(c) and getattr(c, "__closure__", None) for d in held(c)]
    assert held(provider) == []


def test_index_build_embeds_each_document_once(spark, monkeypatch):
    from lectern.plans import chunks as C
    plans = []
    monkeypatch.setattr(C.X, "write_index", lambda rows, *a, **kw: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    C.build(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2
    for plan in plans:  # the half is chosen below both Python steps
        assert "% 2" not in plan.split("MapInArrow")[0] and "% 2" in plan.split("MapInArrow")[1]


def test_evaluation_reads_the_retrieved_rows_once(spark):
    from lectern.operators import answer as A
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b
    q = spark.createDataFrame([(i, f"one two {i}.", "a.") for i in range(7)], "item_id long, question string, answer string")
    schema = "item_id long, rank long, content string, title string, url string, path string"
    got = spark.createDataFrame([(i, r, f"one two {i}. x", "t", f"u{r}", "p") for i in range(6) for r in (1, 2)], schema).mapInPandas(seen, schema)
    out = A.evaluate(q, got, A.matching_sentence, A.same_words).collect()
    assert len(out) == 7 and read.value == 12


def test_rows_are_placed_by_one_python_stage_and_others_stay_without_cells(spark):
    """a filter on the cells must not make a second Python stage of the placing, with workers of its own."""
    rows = [(i, f"t{i}", v) for i, v in enumerate([[0.0, 0.1], [9.0, 9.1], None, [1.0, 2.0, 3.0], [8.0, 8.0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, vec array<double>")
    centroids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "cell int, vec array<double>")
    placed = X._with_cells(df, centroids, 1)
    assert [(r.doc_id, r.text, r.vec, r.cells) for r in placed.orderBy("doc_id").collect()] == [(*r, c) for r, c in zip(rows, [[0], [1], [], [], [1]])]
    assert [(r.cells, [round(g, 6) for g in r.gaps]) for r in X._with_cells(df.where("doc_id = 4"), centroids, 2).collect()] == [([1, 0], [round(2 ** 0.5, 6), round(128 ** 0.5, 6)])]
    plan = placed.where(F.size("cells") > 0).withColumn("cell", F.col("cells")[0]).withColumn("gap", F.col("gaps")[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
