"""Order-dependent helpers that stay bounded when one key holds a large share of rows.

A window partitioned by a key sends all rows of that key to one task.  The
helpers below use two levels instead: rows are bucketed, the order-dependent
step runs inside each bucket, and a window over one summary row per bucket
stitches the buckets together.  Within a key, buckets are ``ordinal //
bucket_width`` (turn numbers); over a whole table they are ranges between
quantiles of the ordinal, so sparse, hashed or skewed ids fill them evenly.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

DEFAULT_BUCKET, MOST_RANGES = 1 << 16, 4096
_LOCAL_ROW = (1 << 33) - 1  # the row number inside a partition in monotonically_increasing_id


def rank_rows(df: DataFrame, *order: Column, out: str = "rank") -> tuple[DataFrame, int]:
    """(``df`` with its rank from 1 in ``order`` as a long column ``out``, number of rows).

    Rows are dealt in ranges of the sort keys and sorted there; a row's rank is
    its place in its range plus the rows of the ranges before it (one row a
    range).  Rows that tie in every key are dealt by their place in ``df``, so a
    key that holds a third of the rows spreads too.  Pass slim rows: they are
    shuffled once and checkpointed once.
    """
    keys = [*order, F.col("_tie")]
    dealt = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
             .withColumn("_part", F.spark_partition_id())
             .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_ROW))))
    dealt = cut_lineage(dealt.drop("_tie"))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = dealt.join(F.broadcast(before), "_part")  # bounded: one row a range
    return ranked.withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before"), total


def range_buckets(df: DataFrame, order: str, *, out: str = "_bucket", rows: int = DEFAULT_BUCKET, most: int = MOST_RANGES) -> DataFrame:
    """``df`` with a number of the range that ``order`` lies in, ascending from 0.

    Ranges lie between quantiles and hold about ``rows`` rows (more where that
    would take over ``most`` ranges).  Rows of one ordinal share a range; null ordinals have none (null).
    """
    place = F.col(order).cast("double")  # monotone: two longs that round to one double share a range
    n = df.where(F.col(order).isNotNull()).count()
    ranges = min(most, max(1, -(-n // rows)))
    cuts = []
    if ranges > 1:
        cuts = df.agg(F.percentile_approx(place, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    if not cuts:
        return df.withColumn(out, F.when(F.col(order).isNotNull(), F.lit(0)))
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    placed = df.withColumn("_place", F.coalesce(place, F.lit(0.0)))
    placed = Bucketizer(splits=splits, inputCol="_place", outputCol=out).transform(placed)
    return placed.withColumn(out, F.when(F.col(order).isNotNull(), F.col(out).cast("int"))).drop("_place")


def running_sum(df: DataFrame, *, order: str, value: str, out: str, keys: list[str] | None = None,
                bucket_width: int = DEFAULT_BUCKET, sparse: bool | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order`` (per ``keys``), as a long column ``out``.

    Rows with a null ``order`` are left out.  ``sparse`` (always so without
    keys) buckets by quantile ranges of the whole table's ``order``, whatever
    its values; ``df`` is then read several times: pass a table or a checkpoint.
    """
    keys = keys or []
    ranges = not keys if sparse is None else sparse
    b = range_buckets(df, order, rows=bucket_width) if ranges else df.withColumn("_bucket", F.floor(F.col(order) / bucket_width))
    totals = b.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_btotal"))
    wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_boff", F.coalesce(F.sum("_btotal").over(wb), F.lit(0))).drop("_btotal")
    wi = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = b.withColumn("_in", F.coalesce(F.sum(value).over(wi), F.lit(0)))
    return (inner.join(offsets, [*keys, "_bucket"])
            .withColumn(out, (F.col("_boff") + F.col("_in")).cast("long"))
            .drop("_bucket", "_boff", "_in"))


def lead_columns(df: DataFrame, *, keys: list[str], order: str, cols: list[str], prefix: str = "next_",
                 bucket_width: int = DEFAULT_BUCKET) -> DataFrame:
    """``lead(col)`` over ``partitionBy(keys).orderBy(order)`` for each of ``cols``,
    named ``prefix + col``, plus ``prefix + order`` (null for the last row of a key)."""
    names = [order, *cols]
    b = df.withColumn("_bucket", F.floor(F.col(order) / bucket_width))
    w_in = Window.partitionBy(*keys, "_bucket").orderBy(order)
    inner = b.withColumn("_nxt", F.lead(F.struct(*[F.col(c).alias(c) for c in names])).over(w_in))
    heads = (b.groupBy(*keys, "_bucket")
             .agg(F.min_by(F.struct(*[F.col(c).alias(c) for c in names]), F.col(order)).alias("_head")))
    w_b = Window.partitionBy(*keys).orderBy("_bucket")
    bridges = heads.withColumn("_bridge", F.lead("_head").over(w_b)).drop("_head")
    j = inner.join(bridges, [*keys, "_bucket"], "left")
    nxt = F.coalesce(F.col("_nxt"), F.col("_bridge"))
    return (j.select(*[F.col(c) for c in df.columns],
                     *[nxt[c].alias(prefix + c) for c in names]))
