"""Importance resampling towards a target distribution by hashed word n-grams.

The n-grams of a batch of texts are interned in an open-addressed numpy table:
xxhash64 of their bytes is the key, the bytes themselves decide (two n-grams
with one hash stay apart), and a slot stores the n-gram's bucket and its count
in the batch.  The bucket is thus computed once per distinct n-gram.  Counting
adds slot counts into the buckets; scoring gathers each occurrence's gain
through its slot id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import lots, saved
from lectern.operators.ordered import rank_rows
from lectern.session import ship_package

BUCKETS, MAX_N = 10_000, 2
#: Bytes of text interned at a time, and words of one piece of a long text.
LOT, PIECE = 1 << 20, 1 << 17

#: A-Z to a-z; every other ASCII byte that is no digit or letter becomes a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (  # fixed values of xxhash64
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs of a-z (A-Z lower-cased), 0-9 and everything outside ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_spans(buf: bytes, lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the spans of ``buf``; ``lanes[i]`` holds the 8 bytes from i on, little-endian."""
    h = _P5 + length.astype(np.uint64)
    at = start.copy()
    for step in range(3):  # whole lanes of spans under 32 bytes
        own = np.flatnonzero(length >= 8 * (step + 1))
        if not len(own):
            break
        h[own] = _rotl(h[own] ^ (_rotl(lanes[at[own]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[own] += 8
    rest = length & 7
    own = np.flatnonzero(rest >= 4)
    h[own] = _rotl(h[own] ^ ((lanes[at[own]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[own] += 4
    rest = rest & 3
    for step in range(3):
        own = np.flatnonzero(rest > step)
        h[own] = _rotl(h[own] ^ ((lanes[at[own] + step] & np.uint64(0xFF)) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= 32):
        h[i] = xxhash.xxh64_intdigest(buf[start[i]:start[i] + length[i]])
    return h


class GramTable:
    """The word n-grams of some pieces of text, interned.

    ``pieces`` are words joined by one blank; a piece with ``carry`` words
    repeats that many words of the piece before it in the same text, and
    n-grams inside them are not counted again.  Per occurrence: ``piece`` and
    ``slot``; per slot: ``bucket`` and ``count`` (0 where the slot is free).
    """

    def __init__(self, pieces: list[bytes], carry: np.ndarray, max_n: int = MAX_N, buckets: int = BUCKETS):
        buf = b"\n".join(pieces) + b"\n" + bytes(8)
        raw = np.frombuffer(buf, np.uint8)
        lanes = np.ascontiguousarray(np.ndarray(len(buf) - 7, "<u8", buffer=buf, strides=(1,)))
        cut = np.flatnonzero((raw[:-8] == 0x20) | (raw[:-8] == 0x0A))
        begin = np.concatenate([[0], cut[:-1] + 1])
        owner = np.concatenate([[0], np.cumsum(raw[cut] == 0x0A)[:-1]])
        real = cut > begin  # an empty piece holds no word
        begin, end, owner = begin[real], cut[real], owner[real]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)  # place of a word in its piece
        self.words = np.bincount(owner[nth >= carry[owner]], minlength=len(pieces))
        starts, lengths, owners = [], [], []
        for n in range(1, max_n + 1):
            m = len(begin) - n + 1
            if m <= 0:
                break
            new = (owner[:m] == owner[n - 1:]) & (nth[n - 1:] >= carry[owner[:m]])  # its last word is not a repeated one
            starts.append(begin[:m][new])
            lengths.append(end[n - 1:][new] - begin[:m][new])
            owners.append(owner[:m][new])
        start, length, self.piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, owners))
        self._intern(buf, lanes, start, length)
        self.count = np.bincount(self.slot, minlength=len(self._first))
        used = np.flatnonzero(self._first >= 0)
        self.bucket = np.zeros(len(self._first), np.int64)
        a, b = start[self._first[used]], (start + length)[self._first[used]]
        self.bucket[used] = [zlib.crc32(buf[x:y]) % buckets for x, y in zip(a.tolist(), b.tolist())]

    def _intern(self, buf: bytes, lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Slot of every occurrence by linear probing; the table is at most half full."""
        n = len(start)
        size = 1 << max(4, (2 * n).bit_length())
        key = xxhash64_spans(buf, lanes, start, length)
        first = np.full(size, -1, np.int64)  # occurrence that owns a slot
        slot = (key & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            at = slot[todo]
            free = first[at] < 0
            first[at[free]] = todo[free]
            own = first[at]
            same = own == todo
            same[~same] = (key[own[~same]] == key[todo[~same]]) & self._equal(lanes, start, length, own[~same], todo[~same])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        self.slot, self._first = slot, first

    @staticmethod
    def _equal(lanes: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte verification of occurrence pairs, eight bytes at a time."""
        same = length[a] == length[b]
        live, done = np.flatnonzero(same), 0
        while len(live):
            left = length[a[live]] - done
            live, left = live[left > 0], left[left > 0]
            diff = lanes[start[a[live]] + done] ^ lanes[start[b[live]] + done]
            diff <<= (8 * np.maximum(0, 8 - left)).astype(np.uint64)  # bytes behind the span do not count
            same[live[diff != 0]] = False
            live = live[diff == 0]
            done += 8
        return same


def _pieces(texts: list[str | None], max_n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words joined by blanks, repeated words at the front, text number): a long text makes several pieces."""
    out, carry, owner = [], [], []
    for i, t in enumerate(texts):
        words = words_of(t)
        for lo in range(0, max(1, len(words)), PIECE):
            back = min(lo, max_n - 1)
            out.append(b" ".join(words[lo - back:lo + PIECE]))
            carry.append(back)
            owner.append(i)
    return out, np.array(carry, np.int64), np.array(owner, np.int64)


def _tables(texts: list[str | None], max_n: int, buckets: int) -> Iterator[tuple[GramTable, np.ndarray]]:
    """Tables over the pieces of the texts in bounded lots, with the text number of each piece."""
    out, carry, owner = _pieces(texts, max_n)
    size, lo = 0, 0
    for i, p in enumerate(out):
        size += len(p)
        if size >= LOT or i + 1 == len(out):
            yield GramTable(out[lo:i + 1], carry[lo:i + 1], max_n, buckets), owner[lo:i + 1]
            size, lo = 0, i + 1


def bucket_counts(docs: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-gram occurrences of all texts per bucket, the empty buckets left out.

    Every partition adds its slot counts into one array, so at most ``buckets`` rows a partition are shuffled.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for sub in lots(batch, 0, 1 << 14, LOT):
                for table, _ in _tables(sub.column(0).to_pylist(), max_n, buckets):
                    np.add.at(total, table.bucket, table.count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])
    return docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket: 1000 times the log of its smoothed share in the target over that in ``docs``, floored."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for into, table in ((s, docs), (t, target)):
        for r in bucket_counts(table, text, max_n, buckets).collect():  # at most one row a bucket
            into[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in thousandths and floored: from the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def score_documents(docs: DataFrame, target: DataFrame, *, seed: int = 7, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score (all long; columns of these names are replaced).

    n_features counts the runs of 1 to ``max_n`` consecutive words, repeats
    included; weight is the floored mean of their gains (0 without features);
    score is weight plus Gumbel noise from the id.  Null and wordless texts
    have no features; a null id takes the noise of the empty id; rows that
    share an id share its noise; long texts are read whole, in pieces; an
    empty table gives an empty table, and an empty target gains that fall as
    a bucket fills.  No shuffle but the counts: 10,000 gains are broadcast.
    """
    gains = bucket_gains(docs, target, max_n=max_n, buckets=buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one long a bucket

    @F.pandas_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for batch in batches:
            words, grams, total = (np.zeros(len(batch), np.int64) for _ in range(3))
            at = 0
            for sub in lots(pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["t"]), 0, 1 << 14, LOT):
                for table, owner in _tables(sub.column(0).to_pylist(), max_n, buckets):
                    row = at + owner
                    np.add.at(words, row, table.words)
                    own = row[table.piece]
                    by_slot = gain[table.bucket]
                    grams += np.bincount(own, minlength=len(batch))
                    # sums of longs stay exact in doubles: a lot holds far fewer than 2**53 / 10**6 occurrences
                    total += np.bincount(own, by_slot[table.slot], len(batch)).astype(np.int64)
                at += sub.num_rows
            yield pd.DataFrame({"n_words": words, "n_features": grams, "weight": total // np.maximum(grams, 1)})
    own = ("n_words", "n_features", "weight", "score")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    out = docs.select(*keep, weigh(F.col("text")).alias("__w"))
    return out.select(*keep, F.col("__w.n_words"), F.col("__w.n_features"), F.col("__w.weight"), (F.col("__w.weight") + noise(F.col("doc_id"), seed)).alias("score"))


def draw(scored: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``score_documents``.

    Of the N rows with ``min_words`` words or more, the floor(percent * N / 100)
    with the highest scores are drawn and ranked from 1, ties to the smaller
    id and null ids last among them; rank is null for the others.  Rows that
    tie in both are ranked in the table's order.  Slim rows are
    dealt in ranges of (score, id), so no task holds them all.
    """
    slim = saved(scored.select("doc_id", "n_words", "n_features", "weight", "score"), "scores")
    fit = F.col("n_words") >= min_words
    ranked, n = rank_rows(slim.where(fit), F.desc("score"), F.asc_nulls_last("doc_id"), out="rank")
    last = percent * n // 100
    cols = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*cols, F.when(F.col("rank") <= last, F.col("rank")).alias("rank"))
    return drawn.unionByName(slim.where(~fit).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, seed: int = 7,
             max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents, all columns and whole texts, with their weight and score.

    The texts stay where they are: the last drawn row's (score, id) is the cut.  Rows that
    share that score and id are all drawn.
    """
    scored = score_documents(docs, target, seed=seed, max_n=max_n, buckets=buckets)
    cut = draw(scored, percent, min_words).where("rank is not null").agg(F.max(F.struct("rank", "score", "doc_id")).alias("x")).first()["x"]
    if cut is None:
        return scored.where("false")
    same = F.col("score") == cut["score"]
    tie = same if cut["doc_id"] is None else same & (F.col("doc_id") <= cut["doc_id"])
    return scored.where((F.col("n_words") >= min_words) & ((F.col("score") > cut["score"]) | tie))
