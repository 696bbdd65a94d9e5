"""Rows with vectors held against a stated set of query vectors, in place.

The query side is measured first.  Up to ``limit`` bytes it is broadcast, the
rows stay where they are, and each task keeps only what ``merge`` leaves of
its candidates (a bounded heap a query): nothing is shuffled below the
scoring.  A larger query side is cut into lots and the rows into blocks, and
each (lot, block) pair meets in one group of bounded bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Largest query side that is broadcast; bytes of a lot of queries and of a block of rows beyond it.
LIMIT, LOT_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20, 32 << 20
#: Rows scored at a time, and the fewest that are worth a task of their own.
TILE_ROWS, LEAST_ROWS = 8192, 1024
#: Most partitions that the groups are dealt over.
MOST_PARTS = 4096

Kernel = Callable[[pa.Table, pa.Table], pd.DataFrame]


def by_length(table: pa.Table, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length; the rows hold no null vectors or components."""
    col = table.column(column).combine_chunks()
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    length = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(length) - length
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        if len(at) == len(length):
            yield at, flat.reshape(len(at), d)
        else:
            yield at, flat[begin[at][:, None] + np.arange(d)]


def text_slices(batch: pa.RecordBatch, column: int, *, rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``size`` bytes of text in ``column`` (one row at least).

    Spark's batches hold up to 10,000 rows or 64 MB; as Python objects, with what is made of them, only a slice is held.
    """
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def size_of(df: DataFrame, vector: str) -> tuple[int, int]:
    """(rows, bytes) of a table of doubles, by one aggregation."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size(vector), F.lit(0)))).first()
    return r[0], 8 * (r[1] or 0) + 64 * r[0]


def scan_against(rows: DataFrame, queries: DataFrame, kernel: Kernel, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *,
                 vector: str = "vec", key: str = "id", limit: int = LIMIT, lot_bytes: int = LOT_BYTES, block_bytes: int = BLOCK_BYTES,
                 grid: tuple[int, int] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Candidates of all ``queries`` among all ``rows``: what ``merge`` leaves of ``kernel(queries, rows)`` per task.

    Both sides have a long ``key`` and a non-null array of doubles or floats ``vector``; further
    columns go to the kernel as they are.  ``merge`` drops candidates that lose
    against others of the same query and may be applied any number of
    times; the caller merges the tasks' survivors.  No rows on either side give no candidates.
    ``grid`` pins (lots, blocks) and takes the second path.  ``kernel`` meets at most ``tile_rows`` rows at a time.
    """
    types = to_arrow_schema(T._parse_datatype_string(schema))
    nq, q_bytes = size_of(queries, vector)
    nr, r_bytes = size_of(rows, vector)
    if q_bytes <= limit and grid is None:
        step = max(1, nq * lot_bytes // max(1, q_bytes))  # queries of a lot
        shared = rows.sparkSession.sparkContext.broadcast(queries.toArrow())  # measured above

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            parts = [q.slice(lo, step) for lo in range(0, q.num_rows, step)]
            held: list[pd.DataFrame | None] = [None] * len(parts)
            for batch in batches:
                for lo in range(0, batch.num_rows, tile_rows):
                    tile = pa.Table.from_batches([batch.slice(lo, tile_rows)])
                    for i, part in enumerate(parts):  # so that only a part's candidates are sorted at a time
                        found = kernel(part, tile)
                        held[i] = merge(found if held[i] is None else pd.concat([held[i], found], ignore_index=True))
            for best in held:
                if best is not None:
                    yield from pa.Table.from_pandas(best, types, preserve_index=False).to_batches(max_chunksize=1 << 16)
        if not nq:
            return rows.sparkSession.createDataFrame([], schema)
        return rows.coalesce(max(1, math.ceil(nr / LEAST_ROWS))).mapInArrow(in_place, schema)
    lots, blocks = grid or (max(1, math.ceil(q_bytes / lot_bytes)), max(1, math.ceil(r_bytes / block_bytes)))
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_lot", own(lots)).withColumn("_block", every(blocks))
    x = rows.withColumn("_block", own(blocks)).withColumn("_lot", every(lots))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = _table(left, sides[0]), _table(right, sides[1])
        held = merge(kernel(a, b.slice(0, tile_rows)))
        for lo in range(tile_rows, b.num_rows, tile_rows):
            held = merge(pd.concat([held, kernel(a, b.slice(lo, tile_rows))], ignore_index=True))
        return held
    sides = to_arrow_schema(queries.schema), to_arrow_schema(rows.schema)
    parts = min(MOST_PARTS, 4 * lots * blocks)  # mostly one group a task
    q, x = q.repartition(parts, "_lot", "_block"), x.repartition(parts, "_lot", "_block")
    return q.groupBy("_lot", "_block").cogroup(x.groupBy("_lot", "_block")).applyInPandas(meet, schema)


def _table(group: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(group[schema.names], schema, preserve_index=False)
