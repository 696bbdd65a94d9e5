"""Operators without an exact SQL form (or whose blocking must be exact) against
brute force on small fixtures derived by fixed rules."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import neardup as ND
from lectern.operators import quota as QU
from lectern.operators.vectors import knn_join


def lev(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def ratio(a: str, b: str):
    m = max(len(a), len(b))
    return None if m == 0 else 1.0 - lev(a.lower(), b.lower()) / m


def _questions(seed=7, n=120):
    rnd = random.Random(seed)
    words = "what when does the prayer fasting pilgrimage alms purity rule time place who how é ü ß".split()
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 14))) for _ in range(n // 3)]
    out = []
    for s in base:
        out.append(s)
        for _ in range(2):                      # near copies with a few random edits
            t = list(s)
            for _ in range(rnd.randint(0, max(1, len(t) // 6))):
                k = rnd.randrange(len(t) + 1)
                op = rnd.random()
                if op < 0.4 and t:
                    t[min(k, len(t) - 1)] = rnd.choice("abcxyzÉ ")
                elif op < 0.7:
                    t.insert(k, rnd.choice("abcxyz "))
                elif t:
                    del t[min(k, len(t) - 1)]
            out.append("".join(t).upper() if rnd.random() < 0.2 else "".join(t))
    out += ["", "", "ab", "abc", "a"]
    return out


def test_near_duplicate_pairs_equal_brute_force(spark):
    qs = _questions()
    df = spark.createDataFrame(list(enumerate(qs)), "id long, text string")
    got = {(r.id_a, r.id_b) for r in ND.near_duplicate_pairs(df, expand=True).collect()}
    want = {(i, j) for i in range(len(qs)) for j in range(i + 1, len(qs))
            if (r := ratio(qs[i], qs[j])) is not None and r > 0.85}
    assert len(want) > 20
    assert got == want


def test_greedy_first_wins_equals_sequential(spark):
    qs = _questions(seed=11)
    df = spark.createDataFrame(list(enumerate(qs)), "id long, text string")
    got = {r.id: r.kept for r in ND.greedy_first_wins(df).collect()}
    kept = []
    for i, q in enumerate(qs):
        if not any((r := ratio(q, qs[j])) is not None and r > 0.85 for j in kept):
            kept.append(i)
    assert {i for i, k in got.items() if k} == set(kept)


def test_quotas_equal_sequential_loop(spark):
    rnd = random.Random(3)
    rows = [(i, f"L{rnd.randrange(40)}", f"C{rnd.randrange(5)}", rnd.random() < 0.8) for i in range(600)]
    for per_list, per_cat, total in [(2, 20, 100), (1, 3, 10), (3, 50, 1000)]:
        lists, cats, acc = {}, {}, []
        for i, lst, cat, ok in rows:
            if not ok or len(acc) >= total or lists.get(lst, 0) >= per_list or cats.get(cat, 0) >= per_cat:
                continue
            lists[lst] = lists.get(lst, 0) + 1
            cats[cat] = cats.get(cat, 0) + 1
            acc.append(i)
        df = spark.createDataFrame(rows, "ord long, lst string, cat string, ok boolean").where("ok")
        got = QU.apply_quotas(df, list_keys=["lst"], category="cat", order="ord",
                              per_list=per_list, per_category=per_cat, total=total)
        assert sorted(r.ord for r in got.collect()) == acc


def test_token_budget_equals_sequential_fold(spark):
    rnd = random.Random(5)
    rows = [(i * 3 + 1, rnd.randint(0, 400), rnd.randint(0, 200)) for i in range(400)]
    for budget in [1000, 5000, 20000, 10 ** 9]:
        usage, want = 0, []
        for o, est, out in rows:
            if usage >= budget:
                break
            if usage + est > budget:
                continue
            usage += est + out
            want.append((o, usage))
        df = spark.createDataFrame([(o, e, e + x) for o, e, x in rows], "ord long, est long, cost long")
        got = QU.token_budget(df, order="ord", est_in="est", cost="cost", budget=budget, bucket_width=64)
        assert sorted((r.ord, r.usage_after) for r in got.collect()) == want


def test_knn_multi_block_equals_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 16)).astype(np.float32)
    X[10] = X[11]                                   # an exact tie
    rows = [(i, X[i].tolist()) for i in range(len(X))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = knn_join(df, df, 5, query_id="vec_id", index_id="vec_id", exclude_self=True, n_blocks=(3, 4))
    got = {(r.vec_id, r.rank): r.neighbor_id for r in got.collect()}
    Xd = X.astype(np.float64)
    D = ((Xd[:, None, :] - Xd[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (D[i, j], j))[:5]
        assert [got[(i, r + 1)] for r in range(5)] == order


def test_knn_large_norms_close_vectors_and_ties_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    far = rng.normal(size=(120, 8)) * 1e4
    close = 1e4 + rng.normal(size=(120, 8)) * 1e-3
    X = np.concatenate([far, close, np.zeros((60, 8)), np.repeat(far[:1], 20, axis=0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>")
    got = knn_join(df, df, 4, query_id="vec_id", index_id="vec_id", exclude_self=True, n_blocks=(2, 3))
    got = {(r.vec_id, r.rank): r.neighbor_id for r in got.collect()}
    assert len(got) == 4 * len(X)
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (D[i, j], j))[:4]
        assert [got[(i, r + 1)] for r in range(4)] == order


def test_knn_group_returns_exactly_k_rows_a_query():
    import pandas as pd

    from lectern.operators.vectors import _local_topk
    side = pd.DataFrame({"id": range(500), "v": [np.zeros(4)] * 500})
    out = _local_topk(6, True)(side.set_axis(["qid", "qv"], axis=1), side.set_axis(["xid", "xv"], axis=1))
    assert len(out) == 500 * 6


def test_exact_copies_and_expanded_pairs(spark):
    qs = ["same text here", "same text here", "other words", "same text here", "", ""]
    df = spark.createDataFrame(list(enumerate(qs)), "id long, text string")
    copies = {r.id: r.rep_id for r in ND.exact_copies(df).collect()}
    assert copies == {0: 0, 1: 0, 2: 2, 3: 0}
    assert ND.near_duplicate_pairs(df).count() == 0          # one representative per text
    expanded = {(r.id_a, r.id_b) for r in ND.near_duplicate_pairs(df, expand=True).collect()}
    assert expanded == {(0, 1), (0, 3), (1, 3)}
    kept = {r.id: r.kept for r in ND.greedy_first_wins(df).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True}


def test_two_level_lead_and_running_sum_equal_windows(spark):
    from pyspark.sql import Window
    from lectern.operators.ordered import lead_columns, running_sum
    rnd = random.Random(9)
    rows = []
    for key in range(4):
        turns = sorted(rnd.sample(range(0, 400), 60 if key else 150))   # gaps and one hot key
        rows += [(key, t, rnd.randint(0, 50), f"v{key}-{t}") for t in turns]
    df = spark.createDataFrame(rows, "k long, o long, x long, s string")
    got = lead_columns(df, keys=["k"], order="o", cols=["s"], bucket_width=7)
    got = running_sum(got, keys=["k"], order="o", value="x", out="acc", bucket_width=7)
    w = Window.partitionBy("k").orderBy("o")
    want = (df.withColumn("next_o", F.lead("o").over(w)).withColumn("next_s", F.lead("s").over(w))
            .withColumn("acc", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    cols = ["k", "o", "next_o", "next_s", "acc"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())


def _sequential_fold(rows, dups, budget, per_list, per_cat, total):
    usage, lists, cats, acc = 0, {}, {}, []
    dupset = set(dups)
    for o, lst, cat, est, cost in rows:
        if len(acc) >= total or usage >= budget:
            break
        if lists.get(lst, 0) >= per_list or cats.get(cat, 0) >= per_cat:
            continue
        if usage + est > budget:
            continue
        if any((a, o) in dupset for a, _u in acc):
            continue
        usage += cost
        lists[lst] = lists.get(lst, 0) + 1
        cats[cat] = cats.get(cat, 0) + 1
        acc.append((o, usage))
    return acc


def test_strict_fold_equals_sequential_loop(spark):
    rnd = random.Random(21)
    rows = [(i * 2 + 1, f"L{rnd.randrange(30)}", f"C{rnd.randrange(4)}", rnd.randint(1, 300), 0)
            for i in range(300)]
    rows = [(o, lst, cat, est, est + rnd.randint(0, 100)) for o, lst, cat, est, _ in rows]
    orders = [r[0] for r in rows]
    dups = sorted({tuple(sorted(rnd.sample(orders, 2))) for _ in range(120)})
    df = spark.createDataFrame(rows, "o long, lst string, cat string, est long, cost long")
    dp = spark.createDataFrame(dups, "id_a long, id_b long")
    for budget, caps, use_dups in [(10_000, (2, 20, 100), True), (3_000, (1, 5, 12), True),
                                   (10 ** 9, (2, 20, 100), False), (8_000, (3, 40, 60), False)]:
        want = _sequential_fold(rows, dups if use_dups else [], budget, *caps)
        got = QU.strict_fold(df, order="o", list_keys=["lst"], category="cat", est_in="est", cost="cost",
                             budget=budget, per_list=caps[0], per_category=caps[1], total=caps[2],
                             dup_pairs=dp if use_dups else None)
        assert sorted((r.o, r.usage_after) for r in got.collect()) == want, (budget, caps, use_dups)


def _syllable_texts(n, seed=5):
    """Texts of a few syllables, alike in their grams as invented prose is, some with a near copy."""
    rnd = random.Random(seed)
    syllables = "the er on an re ha st th ou in at or nd es tion ble ing ly wh ea".split()
    out = []
    while len(out) < n:
        t = " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(2, 40)))
        out.append(t)
        if rnd.random() < 0.1:
            k = rnd.randrange(len(t))
            out.append(t[:k] + "xyz" + t[k + rnd.randrange(3):])
    return out[:n]


def test_near_duplicate_candidates_are_few(spark):
    """Texts that share their common grams are no candidates (posting lists of grams paired nearly all of like length)."""
    texts = sorted(set(_syllable_texts(800)))
    df = spark.createDataFrame([(i, t, len(t), len(t)) for i, t in enumerate(texts)], "tid long, low string, n int, nl int")
    cand = {(r.ta, r.tb) for r in ND._candidates(df).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
            if abs(len(texts[i]) - len(texts[j])) < 0.15 * max(len(texts[i]), len(texts[j]))}
    bags = [Counter(t) for t in texts]
    near = {(i, j) for i, j in want if (bags[i] - bags[j]).total() <= 4 and ratio(texts[i], texts[j]) > 0.85}
    assert len(want) > 20_000 and len(near) > 30
    assert near <= cand <= want
    assert len(cand) < 3 * len(near)


def test_near_duplicate_pairs_over_many_lots(spark, monkeypatch):
    monkeypatch.setattr(ND, "LOT_ROWS", 7)
    qs = _questions(seed=3, n=60) + _syllable_texts(40)
    df = spark.createDataFrame(list(enumerate(qs)), "id long, text string")
    got = sorted((r.id_a, r.id_b) for r in ND.near_duplicate_pairs(df, expand=True).collect())
    assert got == [(i, j) for i in range(len(qs)) for j in range(i + 1, len(qs))
                   if (r := ratio(qs[i], qs[j])) is not None and r > 0.85]


def test_close_texts_over_many_tiles(monkeypatch):
    texts = [t.lower() for t in _questions(seed=5, n=60) + _syllable_texts(60)]
    texts = [t for t in texts if t]
    n = np.array([len(t) for t in texts])
    whole = {(int(x), int(y)) for i, j in ND._close(texts, n, n, np.arange(len(texts)), None) for x, y in zip(i, j)}
    monkeypatch.setattr(ND, "TILE_ROWS", 11)
    tiles = [(int(x), int(y)) for i, j in ND._close(texts, n, n, np.arange(len(texts)), None) for x, y in zip(i, j)]
    cut = len(texts) // 2
    sides = [(a, None) for a in (np.arange(cut), np.arange(cut, len(texts)))] + [(np.arange(cut), np.arange(cut, len(texts)))]
    parts = [(int(x), int(y)) for a, b in sides for i, j in ND._close(texts, n, n, a, b) for x, y in zip(i, j)]
    assert sorted(tiles) == sorted(parts) == sorted(whole)
    assert {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if ratio(texts[i], texts[j]) > 0.85} <= whole


def _nearest_by_definition(Q, qid, X, xid, k):
    out = []
    for q, i in zip(Q, qid):
        with np.errstate(invalid="ignore"):
            d = ((q - X) ** 2).sum(axis=1)
        own = [j for j in np.flatnonzero(np.isfinite(d) & (xid != i))]
        out += [(int(i), int(xid[j]), d[j]) for j in sorted(own, key=lambda j: (d[j], xid[j]))[:k]]
    return sorted(out)


def test_knn_tiles_and_both_screens_equal_brute_force():
    """the k-th distance of a question carries on over the tiles, in single or double precision, whatever the order or spread of the rows."""
    import pyarrow as pa

    from lectern.operators.vectors import nearest
    rng = np.random.default_rng(4)
    n, more = 2 * 2048 + 77, 512 + 9  # beyond a tile of rows, and of questions
    X, i = rng.normal(size=(n, 16)), np.arange(n)
    odd = X.copy()
    odd[3, 2], odd[5], odd[7] = np.nan, np.inf, 0.0

    def side(ids, m):
        return pa.table({"id": pa.array(ids, pa.int64()), "vec": pa.array(list(m), pa.list_(pa.float64()))})
    for Q, qid, rows, ids in [(X[:more], i[:more], X, i), (X[:90] * 0.01, i[:90], X * np.linspace(50, 0.01, n)[:, None], i + n),
                              (1e4 + X[:60] * 1e-3, i[:60], 1e4 + X * 1e-3, i), (X[:60] * 1e-25, i[:60], X * 1e-25, i), (odd[:60], i[:60], odd, i),
                              (X[:60], i[:60] % 9, X, i % 9), (np.repeat(X[:2], 40, axis=0), i[:80], np.repeat(X[:2], n // 2, axis=0), i[:n // 2 * 2])]:
        got = nearest(5, True)(side(qid, Q), side(ids, rows))
        assert sorted(zip(got["qid"], got["xid"], got["distance"])) == _nearest_by_definition(Q, qid, rows, ids, 5)


def test_knn_graph_and_lsh_replicate_each_vector_a_few_times(spark, monkeypatch):
    """Both sides in blocks of like size, so a vector is copied about as often as the table has blocks, not once per 4,096 rows."""
    from lectern.operators import blocks, vectors as V
    n, dims = 9000, 2
    df = spark.range(0, n, 1, 2).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i).cast("float") for i in range(dims)]).alias("embedding"))
    grids = []
    scan = blocks.scan_against
    monkeypatch.setattr(blocks, "scan_against", lambda *a, **kw: grids.append(kw["grid"]) or scan(*a, **kw))
    V.knn_graph(df, 3)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", (8 * dims + 64) * n // 20)
    V.knn_graph(df, 3)
    assert grids == [(5, 5), (20, 20)]
    plan = V.knn_lsh(df, df, 3, query_id="vec_id", index_id="vec_id", exclude_self=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("FlatMapCoGroupsInPandas")[0].count("Exchange") == 1  # candidates are dealt once, by question
