"""Hard negatives by a secondary-sort shuffle.

1. Every task scores its rows against the anchors and keeps the best rows of
   an anchor's label; one window over those few rows gives its positives.
2. A second scan keeps, per task and positive, the first rows of other labels
   whose score lies in the positive's window.  No other pair leaves its task.
3. The pairs left are packed into (anchor, descending score, id) keys and go
   through ``repartitionAndSortWithinPartitions``.  A streaming iterator then
   meets an anchor's pairs best first: a positive opens its window, a negative is
   emitted for every open window that has room.  It holds the open
   windows of one anchor, never the anchor's pairs.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import saved
from lectern.operators import blocks
from lectern.session import ship_package

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Anchors scored at a time, and pairs aimed at in a partition of the shuffle.
TILE, PAIRS = 512, 100_000

_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_TOP, _SIGN = (1 << 63) - 1, 1 << 63


def finite(embedding: Column) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(embedding: Column, by: int = 256) -> Column:
    """Components as whole numbers, floor(by * x) (in doubles, which hold them exactly)."""
    def whole(x: Column) -> Column:
        y = F.lit(float(by)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole
    return F.transform(embedding, whole)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in doubles up to 2**53 / 100, as Python integers beyond."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if 100 * bound < 2 ** 53:
        return q @ x.T
    whole = [np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x)]
    return np.clip(whole[0] @ whole[1].T, -_TOP, _TOP)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, the first column on ties; -inf never counts."""
    rows, cols, at = [], [], np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        j = scores.argmax(axis=1)
        ok = scores[at, j] > -math.inf
        rows.append(at[ok])
        cols.append(j[ok])
        scores[at[ok], j[ok]] = -math.inf
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _tiles(q: pa.Table, x: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor rows, row numbers, scores, same label) in tiles; row numbers ascend by id."""
    qid, ql, xid, xl = (t.column(c).to_numpy() for t in (q, x) for c in ("id", "label"))
    sides = {m.shape[1]: (at, m) for at, m in blocks.by_length(x, "vec")}
    for qat, qm in blocks.by_length(q, "vec"):
        if qm.shape[1] not in sides:
            continue
        at, m = sides[qm.shape[1]]
        order = np.argsort(xid[at], kind="stable")
        at, m = at[order], m[order]
        for lo in range(0, len(qat), TILE):
            own = qat[lo:lo + TILE]
            yield own, at, _products(qm[lo:lo + TILE], m), ql[own][:, None] == xl[at]


def _frame(q: pa.Table, x: pa.Table, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(anchor, score, other) of found (anchor rows, row numbers, scores)."""
    qi, xi, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"anchor": q.column("id").to_numpy()[qi], "score": np.array([int(v) for v in s] if s.dtype == object else s, np.int64),
                         "other": x.column("id").to_numpy()[xi]})


def _positives(q: pa.Table, x: pa.Table, k: int) -> pd.DataFrame:
    found = []
    qid, xid = q.column("id").to_numpy(), x.column("id").to_numpy()
    for own, at, scores, same in _tiles(q, x):
        same &= qid[own][:, None] != xid[at]
        r, c = _best(np.where(same, scores, -math.inf), k)
        found.append((own[r], at[c], scores[r, c]))
    return _frame(q, x, found)


def _first(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k pairs of each anchor by descending score, then id."""
    pairs = pairs.sort_values(["anchor", "score", "other"], ascending=[True, False, True], kind="stable", ignore_index=True)
    return pairs[pairs.groupby("anchor").cumcount() < k]


def _exact(x: np.ndarray) -> np.ndarray:
    """The numbers as they are where 100 times them is exact, else as Python integers."""
    if x.dtype == object or 100 * float(np.abs(x).max(initial=0)) < 2 ** 53:
        return x
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _in_windows(scores: np.ndarray, tops: np.ndarray, low: int, high: int) -> np.ndarray:
    scores, tops = _exact(scores), _exact(tops)
    return ((100 * scores >= low * tops) & (100 * scores <= high * tops)).astype(bool)


def _window_scores(q: pa.Table) -> np.ndarray:
    """Scores of each anchor's positives as a matrix; -1, whose window is empty, where it has fewer."""
    col = q.column("tops").to_pylist()
    out = np.full((len(col), max((len(c) for c in col), default=0)), -1, np.int64)
    for i, c in enumerate(col):
        out[i, :len(c)] = c
    return out


def _negatives(q: pa.Table, x: pa.Table, k: int, low: int, high: int) -> pd.DataFrame:
    found, tops = [], _window_scores(q)
    for own, at, scores, same in _tiles(q, x):
        rows, cols = [], []
        for w in range(tops.shape[1]):
            fits = _in_windows(scores, tops[own, w][:, None], low, high) & ~same
            r, c = _best(np.where(fits, scores, -math.inf), k)
            rows.append(r)
            cols.append(c)
        if rows:
            r, c = np.unique(np.stack([np.concatenate(rows), np.concatenate(cols)]), axis=1)  # one pair may serve several windows
            found.append((own[r], at[c], scores[r, c]))
    return _frame(q, x, found)


def _first_in_windows(k: int, low: int, high: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Keeps the pairs that are among the first k of one of their anchor's windows at least."""
    def merge(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["anchor", "score", "other"], ascending=[True, False, True], kind="stable", ignore_index=True)
        anchor, keep = pairs["anchor"].to_numpy(), np.zeros(len(pairs), bool)
        for w in [c for c in pairs.columns if c.startswith("top")]:
            fits = _in_windows(pairs["score"].to_numpy(), pairs[w].to_numpy(), low, high)
            nth = np.cumsum(fits) - fits
            keep |= fits & (nth - nth[np.searchsorted(anchor, anchor)] < k)
        return pairs[keep]
    return merge


def _pack(anchor: int, score: int, other: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, id."""
    return struct.pack(">QQQ", anchor + _SIGN, _TOP - score, other + _SIGN)


def _unpack(key: bytes) -> tuple[int, int, int]:
    a, s, o = struct.unpack(">QQQ", key)
    return a - _SIGN, _TOP - s, o - _SIGN


def emit_windows(pairs: Iterator[tuple[bytes, bool]], positives: int = POSITIVES, negatives: int = NEGATIVES,
                 low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) of sorted (key, same label) pairs.

    State: at most ``positives`` windows of the current anchor, and the first ``negatives`` negatives of the
    current score, for a positive of score 0 has them inside its window though they may come before it.
    """
    now, level = None, None
    windows, tied = [], []  # [score, id, emitted]; ids of negatives of the current score
    opened = 0
    for key, same in pairs:
        anchor, score, other = _unpack(key)
        if anchor != now:
            now, level, windows, tied, opened = anchor, None, [], [], 0
        if score != level:
            level, tied = score, []
            windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[0]]
        if same:
            if opened < positives:
                opened += 1
                w = [score, other, 0]
                if low * score <= 100 * score <= high * score:
                    for past in tied:
                        w[2] += 1
                        yield anchor, other, w[2], past, score, score
                windows.append(w)
            continue
        if len(tied) < negatives:
            tied.append(other)
        for w in windows:
            if w[2] < negatives and low * w[0] <= 100 * score <= high * w[0]:
                w[2] += 1
                yield anchor, w[1], w[2], other, w[0], score


def mine_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, limit: int = blocks.LIMIT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors and rows
    of (vec_id, label, embedding); components are whole numbers (see ``scaled``).

    An anchor's positives are the first ``positives`` rows of its label with
    another id, by descending integer inner product, ties to the smaller id.
    Each positive gets the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``,
    in the same order; one without any gives no row.

    Rows with a null id, label or vector or with null or non-finite
    components take no part.  Vectors of different lengths are not compared (no score).  Rows
    that repeat an id are rows of their own among positives and negatives; an
    anchor id that repeats is taken once, with the smallest label and vector.
    Scores beyond a long saturate.  Other columns are ignored; an empty table gives no rows.

    Anchors are broadcast behind a check of their size and meet the rows in blocks beyond it
    (``blocks.scan_against``).  Shuffled: the best pairs of every task, at
    most ``positives * (negatives + 1)`` an anchor, whatever a label's share of the rows.
    """
    ship_package(rows.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        d = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
        return d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))
    r = usable(rows)  # read twice, in place
    q = saved(usable(anchors).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec"), "anchors")
    pair = "anchor long, score long, other long"
    best = saved(blocks.scan_against(r, q, lambda a, x: _positives(a, x, positives), lambda p: _first(p, positives), pair, limit=limit), "positives")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n")  # at most `positives` rows a task and anchor
    tops = best.groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("tops"))  # at most `positives` numbers
    q2 = saved(q.join(tops, q["id"] == tops["anchor"]).select("id", "label", "vec", "tops"), "windows")

    def kernel(a: pa.Table, x: pa.Table) -> pd.DataFrame:
        found = _negatives(a, x, negatives, low, high)
        at = pd.Index(a.column("id").to_numpy()).get_indexer(found["anchor"])
        scores = _window_scores(a)
        for w in range(positives):
            found[f"top{w}"] = scores[at, w] if w < scores.shape[1] else np.full(len(found), -1, np.int64)
        return found
    merge = _first_in_windows(negatives, low, high)
    cols = "".join(f", top{w} long" for w in range(positives))
    worst = blocks.scan_against(r, q2, kernel, merge, pair + cols, limit=limit).select("anchor", "score", "other")
    pairs = saved(best.withColumn("same", F.lit(True)).unionByName(worst.withColumn("same", F.lit(False))), "pairs")
    parts = max(1, math.ceil(pairs.count() / PAIRS))
    ordered = (pairs.rdd.map(lambda p: (_pack(p["anchor"], p["score"], p["other"]), p["same"]))
               .repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8])))
    return rows.sparkSession.createDataFrame(ordered.mapPartitions(lambda it: emit_windows(it, positives, negatives, low, high)), _OUT)
