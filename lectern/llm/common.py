"""Helpers shared by the corpus operators: scratch tables, global order, components.

Scratch tables are Parquet folders under ``spark.checkpoint.dir`` (shared by
driver and executors), so a lost executor never loses intermediate results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import ensure_checkpoint_dir, ship_package

#: Words as every text contract here counts them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(df: DataFrame, tag: str) -> str:
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    return f"{root}/llm-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a scratch table in the shared folder and read it back."""
    ship_package(df.sparkSession)
    path = scratch_path(df, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete the folder of a table made by ``saved`` once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as empty; every other column is ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_id_order(d: DataFrame) -> DataFrame:
    """Range-partition by doc_id and sort, so partition number and row order follow doc_id.

    Null ids come first; rows that share an id are ordered by a hash of their text.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return d.repartitionByRange(*keys).sortWithinPartitions(*keys)


def wide_hash(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes: a 128-bit key that stays collision-free at corpus scale."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def lots(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``size`` bytes of text (one row at least)."""
    total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, base + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the nodes of the edges u-v that are not their own root."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[:len(u)], inv[len(u):]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside a partition, in bounded chunks: each chunk's edges become a star forest."""
    us, vs, n = [], [], 0

    def flush() -> pa.RecordBatch:
        node, root = union_find(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += len(us[-1])
        if n >= 2_000_000:
            yield flush()
            us, vs, n = [], [], 0
    if n:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    lows = both.groupBy("u").agg(F.min("v").alias("lo")).withColumn("lo", F.least("u", "lo"))
    j = both.join(lows, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
    else:
        out = (j.select(F.col("v").alias("u"), F.col("lo").alias("v"))
               .unionByName(lows.select("u", F.col("lo").alias("v"))))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node of the edges (src, dst).

    Each partition first contracts its edges by union-find; alternating
    large-star and small-star steps then run until nothing changes (about
    log(longest path) rounds).  Edges and labels stay in the cluster.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v")
    e = saved(e.mapInArrow(_local_forest, "u long, v long").distinct(), "cc")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        nxt = saved(_star(_star(e, large=True), large=False), "cc")
        drop_saved(e)
        e = nxt
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
