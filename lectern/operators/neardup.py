"""Near-duplicate questions: exact similarity self-join and greedy first-wins removal.

Similarity is ``1 - lev(lower a, lower b) / max(len a, len b)``; a pair is a
near duplicate when it is strictly above ``threshold`` (0.85).

Candidate generation is exact (no pair with ratio > threshold is missed) and
writes no pair that fails its bounds:

* length bands: partners differ in lower-cased length by less than 15 % of the
  longer one, so their log-length bands are the same or at most BANDS apart.  A
  band is cut into lots of bounded rows and bytes, and each two lots within reach meet
  in one group (each text is shipped once per lot within its reach);
* count bound (Gravano et al. VLDB 2001): ``lev <= tau`` leaves at least
  ``max |G| - q*tau`` q-grams (as a bag) in common.  Within a group the bags are rows of
  hashed counts of (gram, k-th occurrence) and one matrix product, tile by tile, bounds
  the common grams of all pairs from above: hashing can only raise the count.

The pairs left are verified with the thresholded built-in ``levenshtein`` and
the exact ratio expression.  Identical texts are collapsed first, so a text that
appears many times costs one row, and expanded back at the end.  The comparisons
still grow with the square of the distinct texts (exact all pairs); rows shuffled and
memory do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import NEAR_DUP_RATIO
from lectern.session import cut_lineage, summary_rows

#: Bands of log-length per ln(1 / ratio): partners are at most that many bands apart.
BANDS = 4
#: Most texts and characters of a lot; texts of a tile of the matrix product and its most cells.
LOT_ROWS, LOT_CHARS = 4096, 4 << 20
TILE_ROWS, TILE_CELLS = 1024, 8 << 20
#: Comparisons that are worth a task of their own.
TASK_PAIRS = 4_000_000


def _band(nl):
    """Log-length band of width ln(1 / ratio) / BANDS."""
    return F.floor(F.log(nl.cast("double")) / F.lit(math.log(1.0 / NEAR_DUP_RATIO) / BANDS)).cast("int")


def _tau(n: np.ndarray) -> np.ndarray:
    """Largest distance with ratio > 0.85 where the longer text has ``n`` characters: 20 * d < 3 * n."""
    return (3 * n - 1) // 20


def _gram_columns(lows: list[str], q: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, column of each bag token (gram, k-th occurrence)) of the texts; ``width`` is a power of two."""
    cps = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in lows]
    n = np.array([len(c) for c in cps], np.int64)
    flat = np.concatenate(cps).astype(np.uint64)
    ng = np.maximum(n - (q - 1), 0)
    ends = np.cumsum(ng)
    owner = np.repeat(np.arange(len(lows)), ng)
    at = (np.cumsum(n) - n)[owner] + np.arange(len(owner)) - (ends - ng)[owner]
    gram = np.zeros(len(at), np.uint64)
    for i in range(q):
        gram = (gram << np.uint64(16)) ^ (gram >> np.uint64(48)) ^ flat[at + i]
        gram *= np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((gram, owner))
    gram = gram[order]  # ``owner`` is ascending and stays so
    place = np.arange(len(gram))
    first = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])][:len(gram)]
    k = place - np.maximum.accumulate(np.where(first, place, 0))
    token = gram + k.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    token = (token ^ (token >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.r_[0, ends], ((token >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)


def _bags(offsets: np.ndarray, columns: np.ndarray, lo: int, hi: int, width: int) -> np.ndarray:
    """Token counts of the texts ``lo`` to ``hi``, a row each."""
    out = np.zeros((hi - lo, width), np.float32)
    cells = columns[offsets[lo]:offsets[hi]] + width * np.repeat(np.arange(hi - lo), np.diff(offsets[lo:hi + 1]))
    np.add.at(out.reshape(-1), cells, np.float32(1))
    return out


def _close(lows: list[str], n: np.ndarray, nl: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of text numbers, of ``left`` with ``right`` or (None) among ``left``, that may be near duplicates."""
    least, most = int(nl.min()), int(nl.max())
    q = 4 if least >= 24 else 2 if least >= 8 else 1
    width = min(1 << 16, max(512, 1 << (12 * most - 1).bit_length()))
    offsets, columns = _gram_columns(lows, q, width)
    ng, tau = np.maximum(nl - (q - 1), 0), _tau(n)
    rows = max(1, min(TILE_ROWS, TILE_CELLS // width))

    def sides(numbers):
        return [(lo, numbers[lo:lo + rows]) for lo in range(0, len(numbers), rows)]
    for lo, a in sides(left):
        A = _bags(offsets, columns, a[0], a[-1] + 1, width)
        for at, b in sides(left if right is None else right):
            if right is None and at < lo:
                continue
            B = A if right is None and at == lo else _bags(offsets, columns, b[0], b[-1] + 1, width)
            reach = np.maximum(tau[a][:, None], tau[b][None, :])
            near = (A @ B.T) >= np.maximum(ng[a][:, None], ng[b][None, :]) - q * reach
            near &= np.abs(nl[a][:, None] - nl[b][None, :]) <= reach
            if right is None and at == lo:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            yield a[i], b[j]


def _close_in_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (ta, tb) of two lots that meet (or of one lot with itself: all rows are ``first``)."""
    group = pa.Table.from_batches(batches)
    group = group.sort_by([("first", "descending")])  # the first lot's texts lie before the other's
    n, nl = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "nl"))
    split = int(np.count_nonzero(group.column("first").to_numpy()))
    numbers, tid = np.arange(group.num_rows), group.column("tid").combine_chunks()
    alone = bool(group.column("alone")[0].as_py())
    if split and (alone or split < len(numbers)):
        for i, j in _close(group.column("low").to_pylist(), n, nl, numbers[:split], None if alone else numbers[split:]):
            if len(i):
                yield pa.RecordBatch.from_arrays([tid.take(pa.array(i)), tid.take(pa.array(j))], ["ta", "tb"])


def _candidates(texts: DataFrame) -> DataFrame:
    """(ta, tb), ta < tb: pairs of texts (tid, low, n, nl) that pass the length and the count bound, each once."""
    spark = texts.sparkSession
    t = texts.where(F.col("tid").isNotNull()).select("tid", "low", "n", "nl", _band(F.col("nl")).alias("band"))
    sizes = {r.band: r for r in summary_rows(t.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum("nl").alias("chars")), 1024)}
    lots = {b: max(math.ceil(r.rows / LOT_ROWS), math.ceil(r.chars / LOT_CHARS)) for b, r in sizes.items()}
    near = {b: [o for o in range(b - BANDS, b + BANDS + 1) if o in lots] for b in lots}
    pairs = sum(sizes[b].rows * sizes[o].rows for b in lots for o in near[b]) // 2
    groups = sum(lots[b] * lots[o] for b in lots for o in near[b])
    n_parts = max(8, min(groups, 16 * spark.sparkContext.defaultParallelism, pairs // TASK_PAIRS))
    around = spark.createDataFrame([(b, lots[b], [(o, lots[o]) for o in near[b]]) for b in lots],
                                   "band int, lots int, others array<struct<band: int, lots: int>>")  # at most 1,024 rows
    own = F.struct(F.col("band"), F.pmod(F.xxhash64("tid"), F.col("lots")).cast("int").alias("lot"))
    every = F.flatten(F.transform("others", lambda o: F.transform(
        F.sequence(F.lit(0), o["lots"] - 1), lambda lot: F.struct(o["band"].alias("band"), lot.alias("lot")))))
    met = (t.join(F.broadcast(around), "band").select("tid", "low", "n", "nl", own.alias("own"), every.alias("every"))
           .select("tid", "low", "n", "nl", "own", F.explode("every").alias("other"))
           .select("tid", "low", "n", "nl", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                   (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("alone")))
    kind = texts.schema["tid"].dataType.simpleString()
    found = met.repartition(n_parts, "a", "b").groupBy("a", "b").applyInArrow(_close_in_group, f"ta {kind}, tb {kind}")
    return found.select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb"))


def exact_copies(df: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Every non-empty text row mapped to its representative (smallest id with the same text).

    Together with ``near_duplicate_pairs`` (pairs between representatives) this is
    the full near-duplicate relation in linear size: copies of a text are
    duplicates of each other (ratio 1) without listing their pairs."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    reps = rows.groupBy("text").agg(F.min("id").alias("rep_id"))
    return rows.join(reps, "text").select("id", "rep_id")


def near_duplicate_pairs(df: DataFrame, *, id_col: str = "id", text_col: str = "text",
                         threshold: float = NEAR_DUP_RATIO, expand: bool = False) -> DataFrame:
    """Pairs (id_a < id_b) of distinct texts with similarity ratio > threshold.

    Returns (id_a, id_b, distance, ratio) with each text represented by its
    smallest id (see ``exact_copies``).  ``expand=True`` lists every id pair
    instead, including the pairs among copies of one text; that output grows
    quadratically with the number of copies, so use it on small inputs only.
    """
    if threshold != NEAR_DUP_RATIO:
        raise ValueError("threshold is fixed by the ratio bounds used for blocking")
    # an empty text has no ratio (0/0) and is never a near duplicate, not even of another empty text
    rows = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .where(F.col("text").isNotNull() & (F.length("text") > 0)))
    # collapse identical texts: one representative per distinct text
    texts = (rows.groupBy("text").agg(F.min("id").alias("tid"))
             .withColumn("low", F.lower("text"))
             .withColumn("n", F.length("text"))
             .withColumn("nl", F.length("low")))
    texts = cut_lineage(texts)     # read by the branches below: materialise once
    cand = _candidates(texts)
    # --- verify
    ta = texts.select(F.col("tid").alias("ta"), F.col("low").alias("la"), F.col("n").alias("na"), F.col("nl").alias("nla"))
    tb = texts.select(F.col("tid").alias("tb"), F.col("low").alias("lb"), F.col("n").alias("nb"), F.col("nl").alias("nlb"))
    # verification is CPU-bound and its rows are small: spread it over every core explicitly
    # (size-based coalescing would pack it into a few tasks)
    n_parts = max(8, 4 * df.sparkSession.sparkContext.defaultParallelism)
    v = cand.repartition(n_parts).join(ta, "ta").join(tb, "tb")
    m = F.greatest("na", "nb")
    bound = F.greatest(F.ceil(F.lit(1.0 - threshold) * m).cast("int"), F.lit(0))
    v = (v.withColumn("bound", bound).where(F.abs(F.col("nla") - F.col("nlb")) <= F.col("bound"))
          .withColumn("distance", F.expr("levenshtein(la, lb, bound)"))
          .where(F.col("distance") >= 0)
          .withColumn("ratio", F.lit(1.0) - F.col("distance") / m)
          .where(F.col("ratio") > F.lit(threshold))
          .select("ta", "tb", "distance", "ratio"))
    if not expand:
        return v.select(F.col("ta").alias("id_a"), F.col("tb").alias("id_b"), "distance", "ratio")
    # --- expand representatives back to all ids; identical texts pair with ratio 1
    members = rows.join(texts.select("text", "tid"), "text").select("id", "tid")
    ma, mb = members.alias("ma"), members.alias("mb")
    same = (ma.join(mb, (F.col("ma.tid") == F.col("mb.tid")) & (F.col("ma.id") < F.col("mb.id")))
            .select(F.col("ma.id").alias("id_a"), F.col("mb.id").alias("id_b"),
                    F.lit(0).alias("distance"), F.lit(1.0).alias("ratio")))
    cross = (v.join(members.withColumnRenamed("tid", "ta").withColumnRenamed("id", "ia"), "ta")
              .join(members.withColumnRenamed("tid", "tb").withColumnRenamed("id", "ib"), "tb")
              .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"),
                      "distance", "ratio"))
    return cross.unionByName(same)


def greedy_first_wins(df: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Keep a row unless it is a near duplicate of an earlier *kept* row (order = id).

    Copies of one text share the fate of the earliest copy and every later copy
    is dropped, so the rounds run on distinct texts only.  Rounds: a text with
    no undecided earlier neighbour is kept; texts with a kept earlier neighbour
    are dropped; repeat (equal to the sequential rule).  Returns ``df`` with a
    boolean ``kept``.
    """
    pairs = near_duplicate_pairs(df, id_col=id_col, text_col=text_col, expand=False)
    e = cut_lineage(pairs.select(F.col("id_a").alias("early"), F.col("id_b").alias("late")))
    involved = e.select(F.col("early").alias("id")).union(e.select(F.col("late").alias("id"))).distinct()
    state = cut_lineage(involved.withColumn("st", F.lit("undecided")))
    while True:  # every round decides the earliest undecided text of each chain
        und = state.where(F.col("st") == "undecided").select("id")
        if und.isEmpty():
            break
        blocked = (e.join(und.withColumnRenamed("id", "early"), "early")
                   .select(F.col("late").alias("id")).distinct())
        keep = und.join(blocked, "id", "left_anti")
        drop = (e.join(keep.withColumnRenamed("id", "early"), "early")
                .select(F.col("late").alias("id")).distinct())
        state = (state.join(keep.withColumn("k", F.lit(True)), "id", "left")
                 .join(drop.withColumn("d", F.lit(True)), "id", "left")
                 .select("id", F.when(F.col("st") != "undecided", F.col("st"))
                         .when(F.col("k"), F.lit("kept"))
                         .when(F.col("d"), F.lit("dropped"))
                         .otherwise(F.lit("undecided")).alias("st")))
        state = cut_lineage(state)
    dropped_reps = state.where(F.col("st") == "dropped").select(F.col("id").alias("_rep"))
    first = (df.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).groupBy(text_col)
             .agg(F.min(id_col).alias("_rep")))
    tagged = df.join(first, text_col, "left")
    tagged = tagged.join(dropped_reps.withColumn("_rep_dropped", F.lit(True)), "_rep", "left")
    kept = (F.col("_rep").isNull()) | ((F.col(id_col) == F.col("_rep")) & F.col("_rep_dropped").isNull())
    return tagged.withColumn("kept", kept).drop("_rep", "_rep_dropped")
