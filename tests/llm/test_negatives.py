"""Hard negatives against brute force, in both plans, and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors, k=5, n=3, low=50, high=95):
    def whole(r):
        return None not in r and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])
    rows = [r for r in rows if whole(r)]
    out = []
    for a, label, v in sorted({r[0]: r for r in sorted((r for r in anchors if whole(r)), reverse=True)}.values()):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, r[2])), r[0], r[1]) for r in rows if len(r[2]) == len(v))
        for ps, pid, _ in [s for s in scored if s[2] == label and s[1] != a][:k]:
            fits = [s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps][:n]
            out += [(a, pid, i + 1, s[1], -ps, -s[0]) for i, s in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchors, **kw):
    got = negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(anchors, SCHEMA), **kw)
    assert got.columns == OUT
    return sorted(tuple(r) for r in got.collect())


def sample(seed=1, n=400, spread=12):
    """Few distinct components, so that scores tie often."""
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(0, 4)), [float(x) for x in rng.integers(-2, spread, 3)]) for i in rng.permutation(n).tolist()]


@pytest.mark.parametrize("limit", [negatives.blocks.LIMIT, 0])
def test_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(negatives.blocks, "LOT_BYTES", 1 << 10)
    rows = sample() + [(7, 1, [1.0, 2.0, 3.0])] * 3 + [(900 + i, 0, [5.0, 5.0, 5.0]) for i in range(60)]
    anchors = [r for r in rows if r[0] % 10 == 0]
    want = brute(rows, anchors)
    assert len(want) > 300
    assert mined(spark, rows, anchors, limit=limit) == want


def test_zero_scores_tie_with_their_positive(spark):
    rows = [(0, 0, [1.0, 0.0]), (5, 0, [0.0, 1.0]), (2, 1, [0.0, 2.0]), (3, 1, [0.0, 3.0]), (9, 1, [0.0, 4.0]), (8, 1, [0.0, 1.0]), (6, 0, [-1.0, 0.0])]
    assert mined(spark, rows, rows[:1]) == [(0, 5, 1, 2, 0, 0), (0, 5, 2, 3, 0, 0), (0, 5, 3, 8, 0, 0)] == brute(rows, rows[:1])


def test_scores_beyond_exact_doubles(spark):
    big = float(1 << 29)
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 7.0]), (2, 0, [big, 6.0]), (3, 1, [big * 0.75, 3.0]), (4, 1, [big * 0.75, 4.0]), (5, 1, [-big, 0.0])]
    assert mined(spark, rows, rows[:1]) == brute(rows, rows[:1])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = sample(2, 60) + [(1000, None, [1.0] * 3), (1001, 0, None), (1002, 0, [1.0, None, 1.0]), (1003, 0, [nan] * 3), (1004, 1, [inf, 1.0, 1.0]), (None, 1, [3.0] * 3),
                            (1005, 2, []), (1010, 2, []), (1006, 3, [4.0]), (1020, 3, [4.0]), (10, 3, [1.0, 1.0, 1.0])]
    anchors = [r for r in rows if r[0] is None or r[0] % 10 == 0]
    assert mined(spark, rows, anchors) == brute(rows, anchors)
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(rows, SCHEMA)
    for x, a in ((empty, some), (some, empty), (empty, empty)):
        assert negatives.mine_negatives(x, a).count() == 0
    clash = some.withColumns({c: F.lit("own") for c in ("id", "vec", "score", "anchor", "other", "same", "tops", "_lot", "_block", "rank")})
    assert sorted(tuple(r) for r in negatives.mine_negatives(clash, clash.where("vec_id % 10 = 0")).collect()) == brute(rows, anchors[:-1] + anchors[-1:])


def test_scaled(spark):
    df = spark.createDataFrame([([0.5, -0.001, -1e-30, 1e30, None],)], "e array<double>")
    assert df.select(negatives.scaled(F.col("e")).alias("e")).first().e == [128.0, -1.0, -1.0, 256e30, None]
