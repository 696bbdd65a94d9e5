"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash among its
s-mers is that of its first or its last one.  Whether a k-mer is chosen
depends on the k-mer alone, so an edit moves anchors without changing them.
Every text has at least one anchor per k - s + 1 characters.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import id_text, lots
from lectern.session import ship_package

K, S = 12, 6
#: Anchors kept in a fingerprint: those of the lowest hashes.
SKETCH = 64
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the closed syncmers; a shorter text is one anchor, '' has none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(c)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if n < k:
        acc = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in c:
                acc = acc * _P + x
            return np.zeros(1, np.int64), (_mix(np.array([acc])) >> np.uint64(32)).astype(np.uint32)
    acc = c[:n - s + 1].copy()
    for i in range(1, s):
        acc *= _P
        acc += c[i:n - s + 1 + i]
    h = _mix(acc)
    w = k - s + 1  # s-mers per k-mer
    low, span = h, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:len(h) - w + 1], low[w - span:])
    at = np.flatnonzero((low == h[:len(low)]) | (low == h[w - 1:]))
    acc = h[at] * _P
    for i in range(s, k, s):  # the k-mer's hash, from s-mers that cover it
        acc = _mix((acc + h[at + min(i, k - s)]) * _P)
    return at, (_mix(acc) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, first positions) of the SKETCH distinct anchors with the lowest hashes."""
    at, h = syncmers(text)
    if len(h) > 4 * SKETCH:  # nothing above the bound can be among the lowest distinct ones, or all are kept
        bound = np.partition(h, 2 * SKETCH)[2 * SKETCH]
        sub = h <= bound
        lows, first = np.unique(h[sub], return_index=True)
        if len(lows) >= SKETCH:
            return lows[:SKETCH], at[sub][first][:SKETCH]
    lows, first = np.unique(h, return_index=True)
    return lows[:SKETCH], at[first][:SKETCH]


def printed(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of (hash, position) pairs, little-endian uint32."""
    return base64.b64encode(np.column_stack([fp[0], fp[1].astype(np.uint32)]).astype("<u4").tobytes()).decode()


def _chain(xs: list[int]) -> int:
    """Length of the longest increasing subsequence: shared anchors that lie in the same order."""
    tails: list[int] = []
    for x in xs:
        i = bisect_left(tails, x)
        tails[i:i + 1] = [x]
    return len(tails)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the lowest anchors of the union that both texts hold in the same order (0 to 1)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:SKETCH]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = both <= union[-1]
    order = np.argsort(a[1][i[inside]], kind="stable")
    return _chain(b[1][j[inside]][order].tolist()) / len(union)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib
    for batch in batches:
        for sub in lots(batch, 1):
            memo: dict[str, tuple] = {}

            def fp(t: str) -> tuple:
                if t not in memo:
                    memo[t] = fingerprint(t)
                return memo[t]
            out = []
            for doc_id, text, nxt in zip(*(sub.column(i).to_pylist() for i in range(3))):
                cut = len(text) // 3
                edited = text[:len(text) - cut] + nxt[:cut]
                a, e = fp(text), fp(edited) if edited == text else fingerprint(edited)
                out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            printed(a), printed(e), likeness(a, e), likeness(a, fp(nxt))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in descending doc_id, the first after the last.

    Null ids come last; rows that share an id are ordered by a hash of their
    text.  Documents are dealt by id ranges; the first row of each range is
    also sent to the range before it, so one shuffle of the texts does and no range is large.
    """
    spark = docs.sparkSession
    d = id_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = d.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    d = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(d.withColumn("place", F.col("key").cast("double")))
    tops = sorted(((r["range"], r.top) for r in d.groupBy("range").agg(F.max("key").alias("top")).collect()), reverse=True)  # one row per range
    # the range above gets the first row of the next one down; the lowest range gets the very first row
    send = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)] if tops else []
    heads = spark.createDataFrame(send, "top long, to double")
    extra = d.join(F.broadcast(heads), F.col("key") == F.col("top")).select("doc_id", "key", "text", F.col("to").alias("range"), F.lit(1).alias("extra"))
    both = d.select("doc_id", "key", "text", "range", F.lit(0).alias("extra")).unionByName(extra)
    w = Window.partitionBy("range").orderBy("extra", F.desc("key"), F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(w)).where("extra = 0").select("doc_id", "text", "next_text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next); null texts are empty; an empty text has the empty
    fingerprint, which is like the empty one only; ids may be null or
    repeated; long texts are read whole; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    return with_next(docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                "edited_fingerprint string, near_edited double, near_next double")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, anchors): all closed syncmers of every text as (position, hash), for positional matching."""
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in lots(batch, 1):
                rows = [[{"pos": int(p), "hash": int(h)} for p, h in zip(*syncmers(t))] for t in sub.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(rows, pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64())])))], ["doc_id", "anchors"])
    ship_package(docs.sparkSession)
    return id_text(docs).mapInArrow(every, "doc_id long, anchors array<struct<pos:long,hash:long>>")
