"""Vector retrieval: exact k-nearest neighbours, LSH candidates, offline embeddings.

Exact kNN (``knn_join``) keeps the index where it lies: the question side is
measured and broadcast, each task scores its rows in tiles with a matrix
product and holds the k nearest of each question, and one window merges k rows
a question and task.  A question side too large to ship meets the index in
bounded (lot, block) groups instead (``blocks.scan_against``), as does the kNN graph.  No pair rows, no cross join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import EMBED_BATCH
from lectern.operators import blocks

#: Fewest rows of a block of the kNN graph, unless its bytes bound it, and the blocks up to which that holds.
LEAST_BLOCK, LEAST_BLOCKS = 2048, 8
#: Questions and rows screened at once per task, components of exact distances held at once.
TILE_QUESTIONS, TILE_COLUMNS, TILE_CELLS = 512, 2048, 1_000_000
#: Rows given to the kernel at once: a block at most, so that the k-th distances of the questions carry on.
SCAN_ROWS = 1 << 16


def whole_vector(vector: Column) -> Column:
    """Not null and without null components."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda v: v.isNull()), F.lit(True))


def nearest(k: int, exclude_self: bool = False) -> blocks.Kernel:
    """The k nearest rows (id, no, vec) of each question (id, vec) by squared distance, ties by (id, no).

    Where the questions list ``cells`` and the rows have a ``cell``, a question meets the rows of its cells only.
    A matrix product screens with a tolerance scaled by the norms; direct sums decide.
    """
    def fn(q: pa.Table, x: pa.Table) -> pd.DataFrame:
        out = [_nearest(q, x, at, k, exclude_self) for at in _meetings(q, x)]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("qid", "xid", "xno", "xcell", "distance"), cols)))
    return fn


def _meetings(q: pa.Table, x: pa.Table):
    """(question rows, index rows) to compare: all, or those of each cell."""
    if "cells" not in q.column_names:
        yield np.arange(q.num_rows), np.arange(x.num_rows)
        return
    cells = x.column("cell").to_numpy()
    probed = q.column("cells").combine_chunks()
    owner, probed = np.repeat(np.arange(q.num_rows), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()
    for c in np.unique(cells):
        own = owner[probed == c]
        if len(own):
            yield own, np.flatnonzero(cells == c)


def _nearest(q: pa.Table, x: pa.Table, at: tuple[np.ndarray, np.ndarray], k: int, exclude_self: bool) -> tuple[np.ndarray, ...]:
    q, x = q.take(at[0]), x.take(at[1])
    qid, xid = q.column("id").to_numpy(), x.column("id").to_numpy()
    xno, xcell = (x.column(c).to_numpy().astype(np.int64) if c in x.column_names else np.zeros(len(xid), np.int64) for c in ("no", "cell"))
    sides, held = {m.shape[1]: (rows, m) for rows, m in blocks.by_length(x, "vec")}, {}
    out = []
    for qrows, Q in blocks.by_length(q, "vec"):
        if Q.shape[1] not in sides:
            continue
        xrows, X = sides[Q.shape[1]]
        if Q.shape[1] not in held:
            held[Q.shape[1]] = _Side(X, xid[xrows], xno[xrows], xcell[xrows])
        for lo in range(0, len(Q), TILE_QUESTIONS):
            out.append(held[Q.shape[1]].nearest(Q[lo:lo + TILE_QUESTIONS], qid[qrows[lo:lo + TILE_QUESTIONS]], k, exclude_self))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (*[np.zeros(0, np.int64)] * 4, np.zeros(0))


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat places of a mask with few true ones: words of eight are looked through first."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at, place = np.nonzero(flat.reshape(-1, 8)[words])
    return words[at] * 8 + place


class _Side:
    """Rows of one vector length, and the k nearest of them of some questions.

    The rows are screened tile by tile against the k-th distance so far of each question, in single precision while that
    leaves few pairs, else in double; a row or question whose squared norm is not finite takes no part.
    """

    def __init__(self, X: np.ndarray, ids: np.ndarray, no: np.ndarray, cell: np.ndarray):
        norm = (X * X).sum(axis=1)
        own = np.isfinite(norm)
        self.X, self.id, self.no, self.cell, self.norm = (a if own.all() else a[own] for a in (X, ids, no, cell, norm))
        self.far = np.sqrt(self.norm.max(initial=0.0))
        least = np.sqrt(self.norm.min(initial=np.inf, where=self.norm > 0))
        self.single = least > 1e-12 and self.far < 1e12  # no square over- or underflows to any effect
        self.screens: dict[type, np.ndarray] = {}
        self.rooms: dict[type, np.ndarray] = {}

    def _room(self, kind: type, rows: int, cols: int) -> np.ndarray:
        """Memory for a tile of distances, used again by the next tile."""
        if kind not in self.rooms:
            self.rooms[kind] = np.empty(TILE_QUESTIONS * min(len(self.X), TILE_COLUMNS), kind)
        return self.rooms[kind][:rows * cols].reshape(rows, cols)

    def _screen(self, kind: type) -> np.ndarray:
        if kind not in self.screens:
            self.screens[kind] = np.concatenate([self.X, self.norm[:, None]], axis=1, dtype=kind, casting="same_kind")
        return self.screens[kind]

    def nearest(self, Q: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, ...]:
        """(question id, row id, no, cell, distance), ascending by question, distance, id, no."""
        qn = (Q * Q).sum(axis=1)
        own = np.isfinite(qn)
        if not own.all():
            Q, ids, qn = Q[own], ids[own], qn[own]
        kinds = [np.float32, np.float64] if self.single and qn.max(initial=0.0) < 1e24 else [np.float64]
        rows, cols, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth = np.full(len(Q), np.inf)
        for lo in range(0, len(self.X), TILE_COLUMNS):
            r, c = self._survivors(Q, ids, qn, kinds, kth, lo, k, exclude_self)
            if exclude_self:
                other = ids[r] != self.id[c]
                r, c = r[other], c[other]
            if not len(r):
                continue
            # exact distance of the survivors by a direct sum, in bounded lots; then exactly k a question
            d = np.empty(len(r))
            lot = max(1, TILE_CELLS // max(1, Q.shape[1]))
            for at in range(0, len(r), lot):
                diff = Q[r[at:at + lot]] - self.X[c[at:at + lot]]
                d[at:at + lot] = (diff * diff).sum(axis=1)
            rows, cols, dist = np.concatenate([rows, r]), np.concatenate([cols, c]), np.concatenate([dist, d])
            best = np.lexsort((self.no[cols], self.id[cols], dist, rows))
            ranked_rows = rows[best]
            best = best[np.arange(len(best)) - np.searchsorted(ranked_rows, ranked_rows) < k]
            rows, cols, dist = rows[best], cols[best], dist[best]
            full = np.flatnonzero(np.bincount(rows, minlength=len(Q)) == k)
            kth[full] = dist[np.searchsorted(rows, full, side="right") - 1]
        return ids[rows], self.id[cols], self.no[cols], self.cell[cols], dist

    def _survivors(self, Q: np.ndarray, ids: np.ndarray, qn: np.ndarray, kinds: list[type], kth: np.ndarray, lo: int, k: int,
                   exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
        """(question, row) of the pairs of the tile at ``lo`` that may be among the k nearest; a screen that leaves many is left out from then on."""
        while True:
            kind = kinds[0]
            X = self._screen(kind)[lo:lo + TILE_COLUMNS]
            D = np.matmul(np.concatenate([-2.0 * Q, np.ones((len(Q), 1))], axis=1, dtype=kind, casting="same_kind"), X.T, out=self._room(kind, len(Q), len(X)))
            unit = 8 * np.finfo(kind).eps * (Q.shape[1] + 8)  # rounding of the product, in squared norms
            slack = unit * (np.sqrt(qn) + self.far) ** 2
            most = kth - qn + slack
            if D.shape[1] >= k and not np.isfinite(kth).all():  # as in the first tile
                if exclude_self:
                    D[ids[:, None] == self.id[None, lo:lo + TILE_COLUMNS]] = np.inf
                most = np.minimum(most, np.partition(D, k - 1, axis=1)[:, k - 1] + 2 * slack)
            found = _true(D <= most.astype(kind)[:, None])
            if len(kinds) == 1 or len(found) <= 1024 + 8 * k * len(Q):
                return found // D.shape[1], found % D.shape[1] + lo
            del kinds[0]


def closest(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Keeps the k nearest candidates of each question."""
    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["qid", "distance", "xid", "xno"], kind="stable", ignore_index=True)
        qid = found["qid"].to_numpy()
        return found[np.arange(len(qid)) - np.searchsorted(qid, qid) < k]
    return merge


CANDIDATES = "qid long, xid long, xno long, xcell long, distance double"


def _local_topk(k: int, exclude_self: bool):
    """``nearest`` over pandas groups of (qid, qv) and (xid, xv)."""
    def table(pdf: pd.DataFrame, key: str, vector: str) -> pa.Table:
        return pa.table({"id": pa.array(pdf[key], pa.int64()), "vec": pa.array([np.asarray(v, np.float64) for v in pdf[vector]], pa.list_(pa.float64()))})

    def fn(qpdf: pd.DataFrame, xpdf: pd.DataFrame) -> pd.DataFrame:
        return nearest(k, exclude_self)(table(qpdf, "qid", "qv"), table(xpdf, "xid", "xv"))[["qid", "xid", "distance"]]
    return fn


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, rank, xid, xno, xcell, distance) of the k nearest candidates of each question, over all tasks."""
    w = Window.partitionBy("qid").orderBy("distance", "xid", "xno")
    return (candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", F.col("rank").cast("long").alias("rank"), "xid", "xno", "xcell", "distance"))


def knn_join(queries: DataFrame, index: DataFrame, k: int = 6, *,
             query_id: str = "query_id", index_id: str = "doc_id",
             query_vector: str = "embedding", index_vector: str = "embedding",
             exclude_self: bool = False, limit: int = blocks.LIMIT,
             n_blocks: tuple[int, int] | None = None) -> DataFrame:
    """Exact k nearest neighbours by squared Euclidean distance.

    Returns ``(query_id, rank, neighbor_id, distance)`` with ``rank`` 1..k,
    ties broken by neighbour id.  Vectors that are null or hold null
    components take no part, vectors of different lengths are never neighbours, and rows
    that repeat an id count each.  A question side of more than ``limit`` bytes is not broadcast;
    ``n_blocks`` pins (question lots, index blocks) and takes that path whatever the size.
    """
    def side(df: DataFrame, key: str, vector: str) -> DataFrame:
        d = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where(F.col("id").isNotNull() & whole_vector(F.col("vec")))
        single = d.schema["vec"].dataType.elementType.typeName() == "float"  # half the bytes to shuffle; scored in double all the same
        return d if single else d.select("id", F.col("vec").cast("array<double>").alias("vec"))
    cand = blocks.scan_against(side(index, index_id, index_vector), side(queries, query_id, query_vector),
                               nearest(k, exclude_self), closest(k), CANDIDATES, limit=limit, grid=n_blocks, tile_rows=SCAN_ROWS)
    return ranked(cand, k).select(F.col("qid").alias(query_id), "rank", F.col("xid").alias("neighbor_id"), "distance")


def knn_graph(vectors: DataFrame, k: int = 6, *, id_col: str = "vec_id",
              vector: str = "embedding", **kw) -> DataFrame:
    """k nearest other vectors for every vector of a table (self excluded).

    Here the questions are the table itself, so both sides are dealt in as many blocks of bounded bytes that meet
    in pairs: each vector is replicated once per block of the other side, twice the square root of the groups in all.
    """
    if "n_blocks" not in kw:
        n, size = blocks.size_of(vectors, vector)
        side = max(1, -(-size // blocks.BLOCK_BYTES), min(LEAST_BLOCKS, -(-n // LEAST_BLOCK)))
        kw["n_blocks"] = (side, side)
    return knn_join(vectors, vectors, k, query_id=id_col, index_id=id_col,
                    query_vector=vector, index_vector=vector, exclude_self=True, **kw)


def attach_metadata(neighbors: DataFrame, docs: DataFrame, *, neighbor_id: str = "neighbor_id",
                    doc_id: str = "doc_id") -> DataFrame:
    """Late materialisation: join text/metadata after the top-k, on the id only."""
    return neighbors.join(docs.withColumnRenamed(doc_id, neighbor_id), neighbor_id, "inner")


def embed_batches(df: DataFrame, batch_size: int = EMBED_BATCH, *, order_col: str = "doc_id",
                  bucket_width: int = 1 << 16) -> DataFrame:
    """Batch plan for an embedding provider, batches of ``batch_size`` consecutive rows.

    ``batch_no = floor(rank / batch_size)`` with the global rank in ``order_col``
    order from a distributed running count (no single-partition window).
    """
    from lectern.operators.ordered import running_sum
    ranked = running_sum(df.withColumn("_one", F.lit(1)), order=order_col, value="_one", out="_rank",
                         bucket_width=bucket_width)
    return ranked.withColumn("batch_no", F.floor(F.col("_rank") / batch_size).cast("long")).drop("_one", "_rank")


def tfidf_embedder(docs: DataFrame, *, text: str = "text", dims: int = 256):
    """Offline text -> vector model (tokenise, hash to ``dims``, IDF, L2-normalise).

    Fitting is one aggregation of a ``dims``-sized document-frequency vector.
    Returns a function mapping a DataFrame with ``text`` to one with ``embedding``
    (ARRAY<FLOAT>), usable for documents and questions alike.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)]
    model = Pipeline(stages=stages).fit(docs.select(text))

    def embed(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return (out.withColumn("embedding", vector_to_array("_vec", "float32"))
                .drop("_tok", "_tf", "_tfidf", "_vec"))
    return embed


def knn_lsh(queries: DataFrame, index: DataFrame, k: int = 6, *, query_id: str = "query_id",
            index_id: str = "doc_id", vector: str = "embedding", exclude_self: bool = False,
            bucket_length: float = 0.25, num_tables: int = 4, seed: int = 7,
            q_block: int | None = None, x_block: int | None = None) -> DataFrame:
    """Approximate k nearest neighbours with random-projection LSH.

    Candidates share a bucket in at least one hash table.  Each bucket is split
    into query blocks and index blocks sized from its own counts (a hot bucket
    becomes several bounded groups, like ``knn_graph``'s blocks: of ``q_block`` by ``x_block`` rows,
    by default as many as its bytes allow), every group is
    scored exactly with the same matrix kernel, and the best k distinct
    neighbours per query are kept.  Recall < 1 by design.
    """
    def block(df: DataFrame) -> int:
        n, size = blocks.size_of(df, vector)
        return max(1, min(blocks.BLOCK_BYTES * n // max(1, size), max(LEAST_BLOCK, -(-n // LEAST_BLOCKS))))
    q_block, x_block = q_block or block(queries), x_block or block(index)
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    x = index.select(F.col(index_id).cast("long").alias("xid"), F.col(vector).alias("xv"))
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("qv"))
    lsh = BucketedRandomProjectionLSH(inputCol="_f", outputCol="_h", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed)
    model = lsh.fit(x.select(array_to_vector("xv").alias("_f")))

    def hashed(df, vcol):
        h = model.transform(df.withColumn("_f", array_to_vector(vcol)))
        h = h.select("*", F.posexplode("_h").alias("tbl", "_hv"))
        return h.withColumn("bucket", vector_to_array("_hv")[0]).drop("_f", "_h", "_hv")
    keys = ["tbl", "bucket"]
    xh, qh = hashed(x, "xv"), hashed(q, "qv")
    sizes = (xh.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nx"))
             .join(qh.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nq")), keys, "inner")
             .withColumn("_xs", F.ceil(F.col("_nx") / x_block).cast("int"))
             .withColumn("_qs", F.ceil(F.col("_nq") / q_block).cast("int"))
             .select(*keys, "_xs", "_qs"))
    xh = (xh.join(sizes, keys)
          .withColumn("xb", F.pmod(F.xxhash64("xid"), F.col("_xs")).cast("int"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1))))
    qh = (qh.join(sizes, keys)
          .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("_qs")).cast("int"))
          .withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("_xs") - 1))))
    gk = [*keys, "qb", "xb"]
    cand = (qh.select(*gk, "qid", "qv").groupBy(*gk).cogroup(xh.select(*gk, "xid", "xv").groupBy(*gk))
            .applyInPandas(_local_topk(k, exclude_self), "qid long, xid long, distance double")
            .repartition("qid").dropDuplicates(["qid", "xid"]).withColumns({"xno": F.lit(0), "xcell": F.lit(0)}))
    return ranked(cand, k).select(F.col("qid").alias(query_id), "rank", F.col("xid").alias("neighbor_id"), "distance")
