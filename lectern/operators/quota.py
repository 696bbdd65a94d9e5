"""Quotas and token budget for Q&A synthesis, in relational form.

Caps (per list 2, per category 20, total 100) are saturating counters over
*valid* candidates in ordinal order, so they equal three nested ranks:
list rank <= 2, then category rank <= 20 among those, then the first 100.
``row_number() <= k`` is planned as a ``WindowGroupLimit`` that runs before the
shuffle, so a hot list or category sends only k rows per map task.  The global
cap is ``orderBy().limit()`` (TakeOrderedAndProject), never an unpartitioned window.

The token budget is a greedy fold (accept when ``usage < budget`` and
``usage + est_in <= budget``; then ``usage += in + out``).  It is computed
exactly over ranges of the order column (``ordered.range_buckets``): running
sums inside each range, one summary row a range, and a walk over the summaries.
A range whose rows all fit is accepted by its offset alone; one without
a candidate small enough for what is left is passed over; the others, where the
budget runs out or a candidate is skipped, are folded row by row, each in one
task of a range's rows.  Later ranges are never read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import MOST_RANGES, range_buckets, running_sum
from lectern.session import cut_lineage, ensure_checkpoint_dir, summary_rows
from lectern.functions.fixed import MAX_PER_CATEGORY, MAX_PER_LIST, MAX_TOTAL, TOKEN_BUDGET


#: Rows that one folded range may accept (a range holds fewer unless the table has over MOST_RANGES times as many).
MOST_FOLDED = 1 << 24


def apply_quotas(cands: DataFrame, *, list_keys: list[str], category: str, order: str,
                 per_list: int = MAX_PER_LIST, per_category: int = MAX_PER_CATEGORY,
                 total: int = MAX_TOTAL) -> DataFrame:
    """W2-W4 over valid candidates (filter invalid rows *before* calling)."""
    w_list = Window.partitionBy(*list_keys).orderBy(order)
    s1 = cands.withColumn("list_rank", F.row_number().over(w_list)).where(F.col("list_rank") <= per_list)
    w_cat = Window.partitionBy(category).orderBy(order)
    s2 = s1.withColumn("category_rank", F.row_number().over(w_cat)).where(F.col("category_rank") <= per_category)
    return s2.orderBy(order).limit(total)


def token_budget(cands: DataFrame, *, order: str, est_in: str, cost: str, budget: int = TOKEN_BUDGET,
                 bucket_width: int = 1 << 16) -> DataFrame:
    """Rows accepted by the greedy budget rule, with ``usage_after``.

    ``order`` must be a unique long (rows without one are left out).  Output: accepted rows + ``usage_after``.
    Ranges hold about ``bucket_width`` rows.  The driver sees one row per range
    and the accepted rows of the ranges that were folded; each of these accepts
    at least one row, so the budget bounds their number.
    """
    spark = cands.sparkSession
    slim = cut_lineage(cands.where((F.col(est_in) <= budget) & F.col(order).isNotNull())
                       .select(F.col(order).alias("o"), F.col(est_in).cast("long").alias("e"), F.col(cost).cast("long").alias("c")))
    w = Window.partitionBy("r").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = range_buckets(slim, "o", out="r", rows=bucket_width).withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/budget-{uuid.uuid4().hex}"
    placed.write.partitionBy("r").parquet(path)  # one folder a range: a fold reads its own range only
    ranges = spark.read.schema(placed.schema).parquet(path)
    stats = ranges.groupBy("r").agg(F.sum("c").alias("total"), F.max("before").alias("top"), F.max(F.col("before") + F.col("e")).alias("peak"), F.min("e").alias("least"))
    stats = sorted(summary_rows(stats, MOST_RANGES), key=lambda s: s.r)
    used, whole, folded = 0, [], []
    for s in stats:
        left = budget - used
        if left <= 0:
            break
        if s.least > left:
            continue
        if s.top < left and s.peak <= left:
            whole.append((s.r, used))
            used += s.total
            continue
        own = ranges.where((F.col("r") == s.r) & (F.col("e") <= left)).select("o", "e", "c").coalesce(1).sortWithinPartitions("o")
        took = summary_rows(own.mapInArrow(_fold(used, budget), "o long, usage_after long"), MOST_FOLDED)
        folded += [(r.o, r.usage_after) for r in took]
        used = max((r.usage_after for r in took), default=used)
    offsets = spark.createDataFrame(whole, "r int, offset long")
    taken = ranges.join(F.broadcast(offsets), "r").select("o", (F.col("offset") + F.col("before") + F.col("c")).alias("usage_after"))
    taken = taken.unionByName(spark.createDataFrame(folded, "o long, usage_after long"))
    return cands.join(taken.withColumnRenamed("o", order), order).select(*[F.col(c) for c in cands.columns], "usage_after")


def _fold(used: int, budget: int):
    """The greedy rule over the rows (o, e, c) of one range, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usage = used
        for batch in batches:
            out = []
            for o, e, c in zip(*(col.to_pylist() for col in batch.columns)):
                if usage < budget and usage + e <= budget:
                    usage += c
                    out.append((o, usage))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["o", "usage_after"])
    return run


def strict_fold(cands: DataFrame, *, order: str, list_keys: list[str], category: str, est_in: str,
                cost: str, budget: int = TOKEN_BUDGET, per_list: int = MAX_PER_LIST,
                per_category: int = MAX_PER_CATEGORY, total: int = MAX_TOTAL,
                dup_pairs: DataFrame | None = None, dup_key: str | None = None,
                ) -> DataFrame:
    """Strict synthesis fold: caps, token budget and near duplicates interleaved as in
    the sequential loop.  ``cands`` are *valid* candidates (invalid ones consume
    nothing) and ``order`` is a unique long.  Returns accepted rows with ``usage_after``.

    A candidate is accepted iff its list, category and total counts are below the
    caps, ``usage < budget``, ``usage + est_in <= budget`` and it is not a
    duplicate of an accepted candidate; acceptance adds ``cost`` to usage.
    Duplicates: two candidates with the same ``dup_key`` (default: none share one),
    or whose keys form a pair in ``dup_pairs`` (``id_a``, ``id_b``, either
    orientation; keys default to ``order``).

    Each round ranks the remaining candidates with the current counts as offsets
    (nested ranks, exact because caps only saturate) and takes a running sum of
    cost.  The round is exact up to its first conflict: a budget failure, or a
    duplicate of an earlier candidate of the same round.  Rows before it are
    accepted or rejected for good, the conflict row is rejected (or ends the fold
    on ``usage >= budget``), and the next round starts after it.  A round holds at
    most ``total`` candidates, so duplicate checks touch small tables only.
    """
    key = dup_key or order
    base = cands.select(order, *list_keys, category, est_in, cost,
                        *([dup_key] if dup_key and dup_key not in (order, category, *list_keys) else []))
    rest = cut_lineage(base.where(F.col(est_in) <= budget))
    sym = None
    if dup_pairs is not None:
        sym = cut_lineage(dup_pairs.select(F.col("id_a").alias("k1"), F.col("id_b").alias("k2"))
                          .unionByName(dup_pairs.select(F.col("id_b").alias("k1"), F.col("id_a").alias("k2"))))
    check_dups = sym is not None or dup_key is not None
    accepted = None
    used, n_acc = 0, 0
    while True:
        if n_acc >= total or used >= budget:
            break
        r = rest
        if accepted is not None:
            lc = accepted.groupBy(*list_keys).agg(F.count(F.lit(1)).alias("_lc"))
            cc = accepted.groupBy(category).agg(F.count(F.lit(1)).alias("_cc"))
            r = r.join(lc, list_keys, "left").join(cc, category, "left")
            if check_dups:
                acc_keys = accepted.select(F.col(key).alias("_k")).distinct()
                blocked = acc_keys
                if sym is not None:
                    blocked = blocked.unionByName(sym.join(acc_keys.withColumnRenamed("_k", "k1"), "k1")
                                                  .select(F.col("k2").alias("_k")))
                r = r.join(blocked.withColumnRenamed("_k", key), key, "left_anti")
        else:
            r = r.withColumn("_lc", F.lit(None).cast("long")).withColumn("_cc", F.lit(None).cast("long"))
        r = (r.withColumn("_lc", F.coalesce("_lc", F.lit(0)))
              .withColumn("_cc", F.coalesce("_cc", F.lit(0))))
        w_list = Window.partitionBy(*list_keys).orderBy(order)
        s1 = r.withColumn("_lr", F.row_number().over(w_list)).where(F.col("_lr") + F.col("_lc") <= per_list)
        w_cat = Window.partitionBy(category).orderBy(order)
        s2 = s1.withColumn("_cr", F.row_number().over(w_cat)).where(F.col("_cr") + F.col("_cc") <= per_category)
        q = cut_lineage(s2.orderBy(order).limit(total - n_acc).drop("_lr", "_cr", "_lc", "_cc"))
        rs = running_sum(q, order=order, value=cost, out="_prefix")
        fails = ((F.col("_prefix") + F.lit(used) >= F.lit(budget)) |
                 (F.col("_prefix") + F.col(est_in) > F.lit(budget - used)))
        first_budget = rs.where(fails).agg(F.min(order).alias("f"), F.min_by("_prefix", order).alias("p")).first()
        f_dup = None
        if check_dups:
            e = q.select(F.col(order).alias("_oe"), F.col(key).alias("_ke"))
            x = q.select(F.col(order).alias("_ox"), F.col(key).alias("_kx"))
            same = e.join(x, (F.col("_ke") == F.col("_kx")) & (F.col("_oe") < F.col("_ox")))
            conflicts = same.select("_ox")
            if sym is not None:
                near = (e.join(sym, F.col("_ke") == F.col("k1"))
                        .join(x, (F.col("k2") == F.col("_kx")) & (F.col("_oe") < F.col("_ox"))))
                conflicts = conflicts.unionByName(near.select("_ox"))
            f_dup = conflicts.agg(F.min("_ox")).first()[0]
        fb = first_budget["f"]
        stops = [v for v in (fb, f_dup) if v is not None]
        f = min(stops) if stops else None
        take = rs if f is None else rs.where(F.col(order) < f)
        take = take.withColumn("usage_after", (F.col("_prefix") + F.col(cost) + F.lit(used)).cast("long")) \
                   .drop("_prefix")
        take = cut_lineage(take)
        # rounds are already materialised: their union needs no further checkpoint
        accepted = take if accepted is None else accepted.unionByName(take)
        n_take = take.count()
        n_acc += n_take
        if f is None:
            break
        if fb is not None and fb == f:
            used += int(first_budget["p"])
            if used >= budget:
                break
        elif n_take:
            used = int(take.agg(F.max("usage_after")).first()[0])
        rest = cut_lineage(rest.where((F.col(order) > f) & (F.col(est_in) <= budget - used)))
    if accepted is None:
        return base.limit(0).withColumn("usage_after", F.lit(0).cast("long"))
    return accepted
