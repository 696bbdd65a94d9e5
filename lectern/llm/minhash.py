"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find.

SuperMinHash (Ertl 2017) walks, for every element, the first steps of one
random permutation of the signature's places; at step j an element offers
``j + r`` (0 <= r < 1) to the place its permutation names.  Values below j + 1
are final once every place has one, so large sets stop after two or three
steps; the places of one element are correlated without repetition, which
lowers the variance against independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, drop_saved, id_text, lots, saved, wide_hash
from lectern.session import ship_package

WORDS = 5
#: 36 bands of 5: a pair at similarity 0.75 meets with probability 1 - (1 - 0.75**5)**36 > 0.9999.
BANDS, ROWS = 36, 5
PLACES = BANDS * ROWS
#: A pair goes on to the full sets from this share of equal places on: four standard deviations
#: of 180 independent places below 0.75 (and those of SuperMinHash deviate less).
SCREEN = 0.62
#: Members of a block of a bucket in the last step.
BLOCK = 1024

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


class Shingler:
    """Distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased, ASCII white space)."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, _WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.cache) > 200_000:
            self.cache.clear()
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(self.cache.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(h))
        if k == 0:
            return h
        acc = np.full(len(h) - k + 1, k, np.uint64)  # a short text's single shingle differs from any longer one
        for i in range(k):
            acc *= _P
            acc += h[i:len(h) - k + 1 + i]
        return np.unique(_mix(acc))


def superminhash(sets: list[np.ndarray], m: int = PLACES) -> np.ndarray:
    """Signatures (uint32) of non-empty sets of hashes, all sets advanced together.

    Step j handles the elements of the sets that still have a place at or
    above j.  Place of an element at step j: its swaps k_0..k_j of a lazy
    Fisher-Yates shuffle, traced back to the position that now holds it.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    best = np.full((n, m), np.inf)
    swaps: list[np.ndarray] = []
    for j in range(m):
        bits = _mix(x + np.uint64(int(_P) * (j + 1) % (1 << 64)))
        r = (bits >> np.uint64(32)).astype(np.float64) / float(1 << 32)
        k = j + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        place = k.copy()
        for i in range(j - 1, -1, -1):
            place = np.where(place == swaps[i], i, place)
        np.minimum.at(best.reshape(-1), owner * m + place, r + j)
        swaps.append(k)
        open_ = best.max(axis=1) >= j + 1
        if not open_.any():
            break
        live = open_[owner]
        if not live.all():
            owner, x = owner[live], x[live]
            swaps = [s[live] for s in swaps]
    step = np.floor(best)
    return (_mix((step * float(1 << 32)).astype(np.uint64) ^ ((best - step) * float(1 << 32)).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the non-empty sets, those of similar size together and in bounded lots."""
    for lo, hi in ((1, 16), (16, 128), (128, 1024), (1024, None)):
        at = np.flatnonzero((sizes >= lo) & ((sizes < hi) if hi else True))
        if len(at):
            lots = np.cumsum(sizes[at]) // 300_000
            for lot in np.unique(lots):
                yield at[lots == lot]


def _sign(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for sub in lots(batch, 1, 1024, 1 << 22):
                sets = [shingle(t) for t in sub.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                sigs = [None] * len(sets)
                digest = [None] * len(sets)
                for at in _groups(sizes):
                    for i, sig in zip(at, superminhash([sets[i] for i in at])):
                        sigs[i] = sig.astype("<u4").tobytes()
                        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(2), sub.column(3), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())],
                                                 ["doc_id", "t0", "t1", "n", "digest", "sig"])
    return sign


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t0, t1) with 128 bits that stand for the text."""
    return id_text(docs).select("doc_id", "text", *[h.alias(f"t{i}") for i, h in enumerate(wide_hash("text"))])


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, t0, t1, n, digest, sig): hash of the text, size of the shingle set, its 128-bit digest and its signature
    (both null for the empty set)."""
    ship_package(docs.sparkSession)
    return _hashed(docs).mapInArrow(_sign(words), "doc_id long, t0 long, t1 long, n long, digest binary, sig binary")


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _unpack(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u4") for x in col.to_pylist()])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose signatures and sizes allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        ok = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (_likeness(_unpack(batch.column(4)), _unpack(batch.column(5))) >= SCREEN)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _verify(words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links: 100 * |intersection| >= 75 * |union| on the full shingle sets."""
        shingle = Shingler(words)
        for batch in batches:
            for sub in lots(batch, 2):
                texts, memo, keep = (sub.column(2).to_pylist(), sub.column(3).to_pylist()), {}, []

                def get(t: str) -> np.ndarray:
                    if t not in memo:
                        memo[t] = shingle(t)
                    return memo[t]
                for x, y in zip(*texts):
                    p, q = get(x), get(y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= 75 * (len(p) + len(q) - both))
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([pa.array(sub.column(0).to_numpy()[keep]), pa.array(sub.column(1).to_numpy()[keep])], ["src", "dst"])
    return verify


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the representatives in ``nodes``, from the rows whose id and text they are."""
    return _hashed(docs).join(nodes, ["doc_id", "t0", "t1"]).select("node", "text").dropDuplicates(["node"])


def _star_links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Confirmed links among candidate pairs (a, b): signature screen, then the full sets."""
    s = sigs.select("node", "n", "sig")
    one = pairs.join(s.toDF("a", "na", "sa"), "a")
    two = one.join(s.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    pairs = saved(two.mapInArrow(_screen, "a long, b long"), "pairs")
    j = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    out = saved(j.mapInArrow(_verify(words), "src long, dst long"), "links")
    drop_saved(pairs)
    return out


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for sub in lots(batch, 1):
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array([shingle(t).astype("<u8").tobytes() for t in sub.column(1).to_pylist()], pa.binary())],
                                                 ["node", "shingles"])
    return sets


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one (bucket, block, block) group that join different components: at most one per member.

    A member is held against those members that are still in another
    component, are of fitting size and pass the signature screen; the full sets decide.
    """
    pdf = pdf.sort_values(["side", "node"], ignore_index=True)
    node, n, label = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["comp"].to_numpy().copy()
    sig = np.stack([np.frombuffer(x, "<u4") for x in pdf["sig"]])
    sets = [np.frombuffer(x, "<u8") for x in pdf["shingles"]]
    left = int((pdf["side"] == 0).sum())
    cross = left < len(pdf)  # two different blocks: left against right; else all of one block
    src, dst = [], []
    for k in range(left):
        rest = np.arange(left if cross else k + 1, len(pdf))
        rest = rest[(label[rest] != label[k]) & (4 * np.minimum(n[rest], n[k]) >= 3 * np.maximum(n[rest], n[k]))]
        if not len(rest):
            continue
        rest = rest[(sig[rest] == sig[k]).mean(axis=1) >= SCREEN]
        for lo in range(0, len(rest), 64):
            some = rest[lo:lo + 64]
            some = some[label[some] != label[k]]
            if not len(some):
                continue
            flat = np.concatenate([sets[i] for i in some])
            at = np.minimum(np.searchsorted(sets[k], flat), len(sets[k]) - 1)
            both = np.add.reduceat(sets[k][at] == flat, np.cumsum([0, *n[some][:-1]]), dtype=np.int64)
            for i in some[100 * both >= 75 * (n[some] + n[k] - both)]:
                if label[i] != label[k]:
                    src.append(node[k])
                    dst.append(node[i])
                    label[label == label[i]] = label[k]
    return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links are Jaccard >= 0.75 of the
    sets of distinct ``words``-word shingles (A-Z lower-cased; a shorter text is one shingle).

    Null or wordless texts have the empty set and link with nothing; a null id
    links with nothing and is kept; rows that share an id are rows of their own,
    each with the links of its own text; long texts are read whole; only doc_id
    and text are read.

    1. Signatures and set digests, in place.  Equal sets collapse to one node, whatever their ids.
    2. Bands give buckets of representatives.  Every member is paired with its
       bucket's smallest member: a linear number of pairs however large the bucket.
    3. Pairs that pass the signature screen are confirmed on the full sets.
    4. In buckets that still hold several components, members are compared
       block by block (1,024 a side) across components, by signature and then on the
       full sets, and a group returns the links that join components, never its
       pairs.  So no two linked texts of a bucket stay apart, and copies that
       already hang together cost nothing more.
    5. Components: union-find in partitions, then star contraction.
    """
    ship_package(docs.sparkSession)
    sigs_all = saved(signatures(docs, words), "sigs")
    some = sigs_all.where("digest is not null and doc_id is not null")
    # one row per distinct set: equal sets are pre-aggregated where they lie
    reps = saved(some.groupBy("digest").agg(F.min(F.struct("doc_id", "t0", "t1", "n", "sig")).alias("x"))
                 .select("digest", "x.*").withColumn("node", F.monotonically_increasing_id()), "reps")  # numbered once, as written
    sigs = reps.select("node", "n", "sig")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.struct(i.alias("band"), F.substr(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS)).alias("key")))
    rows = sigs.select("node", F.explode(band).alias("x")).select("node", F.xxhash64("x.band", "x.key").alias("bucket"))
    heads = (rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = saved(rows.join(heads, "bucket"), "buckets")
    star = members.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    met = reps.join(members.select("node").distinct(), "node", "left_semi").select("doc_id", "t0", "t1", "node")
    texts = saved(_texts(docs, met), "texts")  # the one shuffle of texts
    links = _star_links(star, sigs, texts, words)
    labels = components(links)
    # buckets of three and more whose members are not all in one component
    m = (members.where("members > 2").join(labels, "node", "left")
         .select("bucket", "node", "members", F.coalesce("component", "node").alias("comp")))
    open_ = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    m = saved(m.join(open_, "bucket"), "open")
    sets = saved(texts.join(m.select("node").distinct(), "node", "left_semi")
                 .mapInArrow(_sets(words), "node long, shingles binary"), "sets")
    drop_saved(texts)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("blocks", blocks)
    places = F.transform(F.expr("sequence(0, blocks - 1)"), lambda o: F.struct(
        F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") > o).cast("int").alias("side")))
    m = (m.select("bucket", "node", "comp", F.explode(places).alias("x")).select("bucket", "x.i", "x.j", "x.side", "node", "comp")
         .join(sigs, "node").join(sets, "node"))
    found = m.groupBy("bucket", "i", "j").applyInPandas(_block_links, "src long, dst long")
    links2 = saved(found, "links")
    drop_saved(sets)
    drop_saved(members)
    final = components(links.unionByName(links2))
    group = reps.join(final, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("group"))
    lowest = group.groupBy("group").agg(F.min("doc_id").alias("component"))
    label = group.join(lowest, "group").select("digest", "component")
    out = sigs_all.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(label, "digest", "left")
    comp = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
