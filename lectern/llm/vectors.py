"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one vector kept per group.

Cells prune without losing links.  For unit vectors x (nearest to centroid c)
and y (nearest to c'), y lies on the far side of the plane halfway between c
and c'.  If cos(x, y) >= t, the angle between x and that plane is at most
acos(t), so x . (c - c') <= sqrt(1 - t*t) * |c - c'|.  A vector therefore
visits only the cells that this bound does not rule out, and every pair meets
in exactly one cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import components, saved, union_find, wide_hash
from lectern.session import ship_package

#: Distinct vectors per cell aimed at, and most in one home tile and one lot of visitors.
CELL, TILE, LOT = 4096, 2048, 8192
#: Vectors that the centroids are fitted on, per centroid, and most centroids.
FIT_PER_CELL, MAX_CELLS, ITERATIONS = 64, 4096, 8


def usable(embedding: Column) -> Column:
    """Not null, not empty, not zero, every component finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, k: int, rounds: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means on unit vectors; starts from evenly spread sample rows, keeps empty cells' centroids."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return np.unique(c, axis=0)


def _tiles(shared, threshold: float):
    """Home cell of every vector and the later cells that its links may lie in."""
    slack = math.sqrt(1 - threshold * threshold) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sub = batch.slice(lo, 1024)
                if not sub.num_rows:
                    continue
                cos = unit(sub.column(1).to_pylist()) @ c.T
                home = cos.argmax(axis=1)
                near = cos[np.arange(len(cos)), home][:, None] - cos <= slack * gap[home]
                near &= np.arange(len(c)) > home[:, None]
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), sub.column(1), pa.array(home.astype(np.int32)), pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))],
                    ["node", "embedding", "home", "visits"])
    return place


def _meet(threshold: float):
    """Links of one (tile, lot): weighted counts per vector, and the edges of a spanning forest."""
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        at_home = pdf["is_home"].to_numpy()
        homes, guests = pdf[at_home], pdf[~at_home]
        first = homes["own_lot"].iloc[0] if len(homes) else False
        h, hid, hw = unit(homes["embedding"].tolist()) if len(homes) else None, homes["node"].to_numpy(), homes["copies"].to_numpy()
        counts: dict[int, int] = {}
        us, vs = [], []
        if h is not None:
            sides = [(guests["node"].to_numpy(), guests["copies"].to_numpy(), guests["embedding"].tolist())] if len(guests) else []
            for gid, gw, emb in sides:
                g = unit(emb)
                for lo in range(0, len(g), 1024):
                    hit = h @ g[lo:lo + 1024].T >= threshold
                    if hit.any():
                        for node, n in zip(hid, hit @ gw[lo:lo + 1024]):
                            counts[node] = counts.get(node, 0) + int(n)
                        for node, n in zip(gid[lo:lo + 1024], hw @ hit):
                            counts[node] = counts.get(node, 0) + int(n)
                        a, b = np.nonzero(hit)
                        us, vs = _forest(us, vs, hid[a], gid[lo:lo + 1024][b])
            if first:  # the home vectors among themselves, in one lot only
                hit = h @ h.T >= threshold
                np.fill_diagonal(hit, False)
                hit |= hit.T
                for node, n in zip(hid, hit @ hw):
                    counts[node] = counts.get(node, 0) + int(n)
                a, b = np.nonzero(np.triu(hit))
                us, vs = _forest(us, vs, hid[a], hid[b])
        counts = {k: n for k, n in counts.items() if n}
        node = [*counts, *us]
        return pd.DataFrame({"node": np.array(node, np.int64), "links": np.array([*counts.values(), *[0] * len(us)], np.int64),
                             "root": pd.array([None] * len(counts) + list(vs), dtype="Int64")})
    return meet


def _forest(us, vs, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges so far and new ones, contracted to one edge per node."""
    return union_find(np.concatenate([np.array(us, np.int64), a]), np.concatenate([np.array(vs, np.int64), b]))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing.  Equal vectors are compared once and count as many times
    as they occur; rows that share a vec_id are rows of their own when
    counting; null ids count as vectors, never name a component, and are not
    kept.  Vectors of different lengths never link.  Other columns are ignored.

    The centroids are fitted on at most ``FIT_PER_CELL * cells`` vectors (the lowest
    hashes of the vector); every vector is placed and compared.  The pruning
    is exact, so recall is 1; on vectors without any structure it prunes
    little, and the work then nears all blocked products.  Cells are
    dealt in tiles of 2,048 home vectors and lots of 8,192 visitors, and a
    group returns counts and a spanning forest, never its pairs.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    good = v.where(usable(F.col("embedding")))
    reps = saved(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
                 .withColumn("node", F.monotonically_increasing_id()), "vecs")  # numbered once, as written
    dims = [r.d for r in reps.select(F.size("embedding").alias("d")).distinct().collect()]  # lengths: a handful
    found = None
    for d in dims:
        part = _meetings(spark, reps.where(F.size("embedding") == d), threshold, cells)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, root long")
    found = saved(found, "met")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("root is not null").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = (reps.join(links, "node", "left").join(labels.withColumnRenamed("component", "label"), "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    lowest = named.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    named = saved(named.join(lowest, "label").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    # 128 bits stand for a vector
    keys = [F.when(usable(F.col("embedding")), h).alias(f"key{i}") for i, h in enumerate(wide_hash("embedding"))]
    own = [h.alias(f"key{i}") for i, h in enumerate(wide_hash("embedding"))]
    out = v.select("vec_id", *keys).join(named.select(*own, "component_id", "n_links"), ["key0", "key1"], "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def _meetings(spark: SparkSession, reps: DataFrame, threshold: float, cells: int | None) -> DataFrame:
    """(node, links, root) over the distinct vectors of one length."""
    n = reps.count()
    k = cells or max(1, min(MAX_CELLS, round(n / CELL)))
    order = F.pmod(F.xxhash64(F.lit(7), "embedding"), F.lit(1 << 30))
    share = min(1.0, FIT_PER_CELL * k / n) * float(1 << 30)
    rows = reps.where(order < share * 1.05 + 1024).orderBy(order).limit(max(1, FIT_PER_CELL * k)).select("embedding").toPandas()
    sample = unit(np.stack(rows["embedding"].to_numpy())) if len(rows) else unit(np.stack(reps.limit(1).toPandas()["embedding"].to_numpy()))
    shared = spark.sparkContext.broadcast(fit_cells(sample, min(k, len(sample))))  # at most MAX_CELLS centroids
    kind = reps.schema["embedding"].dataType.simpleString()
    placed = saved(reps.select("node", "embedding").mapInArrow(_tiles(shared, threshold), f"node long, embedding {kind}, home int, visits array<int>")
                   .join(reps.select("node", "copies"), "node"), "placed")
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("homes"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("guests"))
    sizes = homes.join(guests, "cell", "left").select(
        "cell", F.ceil(F.col("homes") / TILE).cast("int").alias("tiles"),
        F.ceil((F.coalesce("guests", F.lit(0)) + F.col("homes")) / LOT).cast("int").alias("lots"))
    sizes = F.broadcast(sizes)  # one row per cell, at most MAX_CELLS
    tile = lambda: F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    lot = lambda: F.pmod(F.xxhash64(F.lit(3), "node"), F.col("lots")).cast("int")
    at_home = (placed.withColumnRenamed("home", "cell").join(sizes, "cell").withColumn("tile", tile())
               .withColumn("lot", F.explode(F.expr("sequence(0, lots - 1)")))
               .select("cell", "tile", "lot", F.lit(True).alias("is_home"), (F.col("lot") == 0).alias("own_lot"), "node", "copies", "embedding"))
    # to the later tiles of its own cell, and to every tile of the cells it visits
    kin = (placed.withColumnRenamed("home", "cell").join(sizes, "cell").withColumn("own", tile()).withColumn("lot", lot()).where("own < tiles - 1")
           .withColumn("tile", F.explode(F.expr("sequence(own + 1, tiles - 1)"))))
    away = (placed.withColumn("cell", F.explode("visits")).join(sizes, "cell").withColumn("lot", lot())
            .withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)"))))
    guest = lambda x: x.select("cell", "tile", "lot", F.lit(False).alias("is_home"), F.lit(False).alias("own_lot"), "node", "copies", "embedding")
    every = at_home.unionByName(guest(kin)).unionByName(guest(away))
    return every.groupBy("cell", "tile", "lot").applyInPandas(_meet(threshold), "node long, links long, root long")
