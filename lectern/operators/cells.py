"""Vector index of chunks: an inverted file with one Parquet folder per cell.

Layout below the index path:

* ``centroids``: (cell, vec), the coarse quantiser, fitted once;
* ``chunks/batch=<name>/cell=<c>``: the rows of one write, each in the cell of
  its nearest centroid;
* ``cells/batch=<name>``: rows and radius (largest distance from the centroid) of each cell of that write;
* ``manifest``: one row per committed write, written after its files.

Readers take the batches of the manifest only, so a write becomes visible as a
whole or not at all, and a repeated write replaces its own folder.  A search
reads the cells that its questions probe (partition pruning) and of these
the vectors alone; texts are read for the k winners.

An exact search first probes a few cells, which bounds the distance of the
k-th neighbour, and then those cells that may hold a nearer one: a row of a
cell is no nearer than the centroid's distance less the radius.  How much that
prunes depends on the data: clustered vectors leave few cells, vectors without any structure nearly all.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.operators import blocks
from lectern.operators.vectors import CANDIDATES, closest, nearest, ranked, whole_vector
from lectern.session import cut_lineage, summary_rows

#: Rows aimed at in a cell, most cells (their centroids are broadcast), rows of the fit per cell.
CELL_ROWS, MAX_CELLS, FIT_PER_CELL = 4096, 16_384, 64
#: Most visible writes; ``compact`` makes one of them.
MAX_WRITES = 100_000
#: Share of the cells that an exact search probes before it bounds the others.
FIRST_SHARE = 0.1
#: Most rows, and distances from centroids, that are held at once where rows are placed in cells.
PLACED_ROWS, PLACED_GAPS = 1024, 1 << 22


def fit_centroids(vectors: DataFrame, cells: int, *, vector: str = "vec", seed: int = 7) -> DataFrame:
    """(cell, vec): k-means centroids of at most FIT_PER_CELL rows a cell, chosen by a hash of the vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    rows = FIT_PER_CELL * cells
    share = min(1.0, 1.1 * rows / max(1, vectors.count()))
    place = F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1 << 30))
    features = array_to_vector(vector).alias("features")
    some = cut_lineage((vectors.where(place < int(share * (1 << 30))) if share < 1 else vectors).select(features))
    if share < 1 and some.isEmpty():  # few distinct vectors, all beyond the share
        some = cut_lineage(vectors.limit(rows).select(features))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, initSteps=2).fit(some)
    centers = [[float(x) for x in c] for c in model.clusterCenters()]  # at most MAX_CELLS
    table = pa.table({"cell": pa.array(range(len(centers)), pa.int32()), "vec": pa.array(centers, pa.list_(pa.float64()))})
    return vectors.sparkSession.createDataFrame(table)  # from Arrow: no Python worker reads it


def _distances(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (m * m).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2.0 * (m @ centroids.T)
    return np.sqrt(np.maximum(d, 0.0))


def _with_cells(df: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """``df`` with the ``probes`` nearest cells of its ``vec``, nearest first (ties: the lower cell), as ``cells``, and the
    distances of their centroids as ``gaps``; vectors of another length have none."""
    table = centroids.orderBy("cell").toArrow()  # at most MAX_CELLS rows
    shared = df.sparkSession.sparkContext.broadcast(np.stack(table.column("vec").to_pylist()).astype(np.float64))

    own = [i for i, c in enumerate(df.columns) if c not in ("cells", "gaps")]
    schema = T.StructType([df.schema.fields[i] for i in own] + [T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("gaps", T.ArrayType(T.DoubleType()))])
    types, vec = to_arrow_schema(schema), df.columns.index("vec")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(1, min(PLACED_ROWS, PLACED_GAPS // len(c)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):  # a slice of a batch is held as matrices, not the batch
                some = batch.slice(lo, step)
                length = some.column(vec).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(length == c.shape[1])
                flat = some.column(vec).take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False)
                d = _distances(np.asarray(flat, np.float64).reshape(len(at), c.shape[1]), c)
                order = d.argmin(axis=1)[:, None] if probes == 1 else np.argsort(d, axis=1, kind="stable")[:, :probes]
                ends = np.zeros(some.num_rows + 1, np.int32)
                ends[1:] = np.cumsum(np.where(length == c.shape[1], order.shape[1], 0))
                made = [pa.ListArray.from_arrays(ends, v.ravel()) for v in (order.astype(np.int32), np.take_along_axis(d, order, axis=1))]
                cols = [some.column(i) for i in own] + made
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, types)], schema=types)
    return df.mapInArrow(near, schema)


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException:  # the folder is not there yet
        return None


_MANIFEST = "seq long, batch string, replaces boolean, n_rows long, columns string"


def manifest(spark: SparkSession, path: str) -> list[Row]:
    """The visible writes in order: the last one that replaced the index, and those after it."""
    m = _read(spark, f"{path}/manifest", _MANIFEST)
    rows = sorted(summary_rows(m, MAX_WRITES), key=lambda r: r.seq) if m is not None else []
    first = max((i for i, r in enumerate(rows) if r.replaces), default=0)
    return rows[first:]


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible writes."""
    return [r.batch for r in manifest(spark, path)]


def write_index(chunks: DataFrame, path: str, *, batch: str, overwrite: bool = False, cells: int | None = None) -> int:
    """Write rows (doc_id, chunk_no, vec, further columns) as one batch; the number of rows written.

    The first write with vectors, and every ``overwrite``, fits the centroids; an append keeps
    them and adds files to its cells, without looking for rows it has seen.  A batch that
    the manifest already names is skipped (a replayed micro-batch); one whose
    write broke off is written again into its own folder.  Rows without a
    whole vector of the index's length stay out.  A cell that holds
    many rows is split over tasks and files by its size.
    """
    spark = chunks.sparkSession
    visible = committed(spark, path)
    if batch in visible:
        return 0
    rows = chunks.where(whole_vector(F.col("vec"))).withColumn("vec", F.col("vec").cast("array<double>"))
    base = batch if overwrite or not visible else visible[0]
    centroids = None if base == batch else _read(spark, f"{path}/centroids/batch={base}")
    if centroids is None:  # a new index, or one whose writes so far had no vectors
        rows = cut_lineage(rows)
        n = rows.count()
        if n:
            k = min(MAX_CELLS, cells or max(2, math.ceil(n / CELL_ROWS)))
            fit_centroids(rows.select("vec"), k).write.mode("overwrite").parquet(f"{path}/centroids/batch={base}")
            centroids = _read(spark, f"{path}/centroids/batch={base}")
    if centroids is None:
        placed = rows.withColumn("cell", F.lit(0)).where("false")
    else:
        placed = _with_cells(rows, centroids, 1).where(F.size("cells") > 0).withColumn("cell", F.col("cells")[0]).withColumn("gap", F.col("gaps")[0])
        placed = placed.drop("cells", "gaps")
    if "gap" not in placed.columns:
        placed = placed.withColumn("gap", F.lit(0.0))
    folder = f"{path}/chunks/batch={batch}"
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(folder)
    done = spark.read.schema(placed.schema).parquet(folder)
    sizes = done.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")
    n = spark.read.schema(sizes.schema).parquet(f"{path}/cells/batch={batch}").agg(F.sum("n")).first()[0] or 0
    m = _read(spark, f"{path}/manifest", _MANIFEST)
    seq = 1 + ((m.agg(F.max("seq")).first()[0] if m is not None else None) or 0)
    entry = pa.table(dict(zip(("seq", "batch", "replaces", "n_rows", "columns"), ([seq], [batch], [bool(overwrite or not visible)], [n], [placed.schema.json()]))))
    spark.createDataFrame(entry).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return n


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the committed batches, with their ``cell`` and ``batch``."""
    writes = manifest(spark, path)
    if not writes:
        raise ValueError(f"no committed write in {path}")
    schema = T.StructType.fromJson(json.loads(writes[0].columns)).add("batch", T.StringType())
    return spark.read.schema(schema).option("basePath", f"{path}/chunks").parquet(*[f"{path}/chunks/batch={r.batch}" for r in writes])


def centroids_of(spark: SparkSession, path: str) -> DataFrame:
    """(cell, vec) of the index; no rows while it holds no vectors."""
    found = _read(spark, f"{path}/centroids/batch={committed(spark, path)[0]}")
    return found if found is not None else spark.createDataFrame([], "cell int, vec array<double>")


def cell_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(cell, n, radius) over the visible writes."""
    parts = spark.read.schema("cell int, n long, radius double").parquet(*[f"{path}/cells/batch={b}" for b in committed(spark, path)])
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 6, *, probes: int | None = None,
           limit: int = blocks.LIMIT) -> DataFrame:
    """(id, rank, distance, all columns of the index but vec, gap and batch) of the k nearest chunks of each question (id, vec).

    By squared Euclidean distance, ties by (doc_id, chunk_no).  Exact, unless
    ``probes`` limits each question to that many nearest cells.  Only
    probed cells are read.  Rows without a doc_id or chunk_no are never found.
    """
    q = questions.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & whole_vector(F.col("vec")))
    centroids = centroids_of(spark, path)
    n = centroids.count()
    if not n:
        index = read_index(spark, path).drop("vec", "gap", "batch")
        return spark.createDataFrame([], "id long, rank long, distance double").join(index.where("false"))
    first = min(n, probes or max(1, math.ceil(FIRST_SHARE * n)))
    q = cut_lineage(_with_cells(q, centroids, n if probes is None else first))
    index = read_index(spark, path).where(F.col("doc_id").isNotNull() & F.col("chunk_no").isNotNull())
    found = _score(index, q.select("id", "vec", F.slice("cells", 1, first).alias("cells")), k, limit)
    if probes is None and first < n:
        found = cut_lineage(found)
        worst = ranked(found, k).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst")).where(F.col("n") == k)
        more = _open_cells(spark, path, q.join(worst.select(F.col("qid").alias("id"), "worst"), "id", "left"), first)
        found = found.unionByName(_score(index, more, k, limit))
    top = cut_lineage(ranked(found, k).select(F.col("qid").alias("id"), "rank", "distance", F.col("xid").alias("doc_id"), F.col("xno").alias("chunk_no"),
                                              F.col("xcell").cast("int").alias("cell")))
    held = [r.cell for r in summary_rows(top.select("cell").distinct(), MAX_CELLS)]  # texts are read from the winners' cells only
    return top.join(index.drop("vec", "gap", "batch").where(F.col("cell").isin(held)), ["cell", "doc_id", "chunk_no"])


def _score(index: DataFrame, q: DataFrame, k: int, limit: int) -> DataFrame:
    """Candidates of the questions (id, vec, cells) among the rows of their cells."""
    probed = [r.c for r in summary_rows(q.select(F.explode("cells").alias("c")).distinct(), MAX_CELLS)]
    rows = index.where(F.col("cell").isin(probed)).select(
        F.col("doc_id").cast("long").alias("id"), F.col("chunk_no").cast("long").alias("no"), "vec", F.col("cell").cast("int").alias("cell"))
    return blocks.scan_against(rows, q, nearest(k), closest(k), CANDIDATES, limit=limit)


def _open_cells(spark: SparkSession, path: str, q: DataFrame, first: int) -> DataFrame:
    """The questions with the cells behind their ``first`` ones that may hold a row nearer than ``worst`` (null: any row)."""
    radii = {r.cell: r.radius for r in summary_rows(cell_sizes(spark, path), MAX_CELLS)}
    shared = spark.sparkContext.broadcast(radii)

    @F.pandas_udf("array<int>")
    def still_open(cells: pd.Series, gaps: pd.Series, worst: pd.Series) -> pd.Series:
        out = []
        for own, gap, w in zip(cells, gaps, worst):
            reach = math.inf if w is None or math.isnan(w) else math.sqrt(w) * (1 + 1e-9) + 1e-9
            out.append([int(c) for c, g in zip(own[first:], gap[first:]) if c in shared.value and g - shared.value[c] <= reach])
        return pd.Series(out)
    q = q.select("id", "vec", still_open("cells", "gaps", "worst").alias("cells"))
    return cut_lineage(q.where(F.size("cells") > 0))


def probed_share(spark: SparkSession, path: str, questions: DataFrame, probes: int) -> float:
    """Share of all (question, chunk) pairs that a search with ``probes`` cells scores."""
    centroids = centroids_of(spark, path)
    q = _with_cells(questions.select(F.col("vec").cast("array<double>").alias("vec")), centroids, min(centroids.count(), probes))
    sizes = cell_sizes(spark, path)
    scored = q.select(F.explode("cells").alias("cell")).join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
    return scored / max(1, questions.count() * (sizes.agg(F.sum("n")).first()[0] or 0))


def compact(spark: SparkSession, path: str, batch: str) -> int:
    """Rewrite the visible rows as one batch, so that many small appends become few files per cell."""
    return write_index(read_index(spark, path).drop("cell", "gap", "batch"), path, batch=batch, overwrite=True)
