"""Packing by power-of-two decomposition.

A document's ids (with an end id) are cut into full pieces of ``max_len`` and
then, for the rest, one piece per set bit of its length, longest first.  Every
piece is a sequence of its own, so a sequence never crosses documents, and
pieces of equal length form one bucket: sequence ids are dense and ordered by
bucket (longest first), then by document id and start.  No padding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import id_text, in_id_order, lots, saved
from lectern.llm.tokens import default_tokenizer, encoder
from lectern.session import ship_package

_SCHEMA = ("doc_id long, doc_tokens long, start long, length long, ids binary, "
           "level int, part int, idx long")


def cut_lengths(sizes: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, length) of the pieces of documents of ``sizes`` ids, in order."""
    full, rest = sizes // max_len, sizes % max_len
    docs, lengths = [np.repeat(np.arange(len(sizes)), full)], [np.full(int(full.sum()), max_len)]
    for bit in range(max_len.bit_length() - 2, -1, -1):
        own = np.flatnonzero(rest >> bit & 1)
        docs.append(own)
        lengths.append(np.full(len(own), 1 << bit))
    docs, lengths = np.concatenate(docs), np.concatenate(lengths)
    order = np.argsort(docs, kind="stable")  # lengths already descend within a document
    return docs[order], lengths[order]


def _cutter(path: str, max_len: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(max_len.bit_length(), np.int64)  # pieces so far per level
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for sub in lots(batch, 1, size=1 << 20):
                ids = [x + end for x in enc.encode_many(sub.column(1).to_pylist())]
                sizes = np.array([len(x) for x in ids]) // enc.dtype.itemsize
                docs, lengths = cut_lengths(sizes, max_len)
                ends = np.cumsum(lengths)
                start = ends - lengths - (np.cumsum(sizes) - sizes)[docs]
                level = np.log2(lengths).astype(np.int64)
                idx = np.empty(len(lengths), np.int64)
                for k in np.unique(level):
                    own = np.flatnonzero(level == k)
                    idx[own] = seen[k] + np.arange(len(own))
                    seen[k] += len(own)
                # a document's pieces lie one after the other, so all pieces share one buffer
                flat = np.frombuffer(b"".join(ids), enc.dtype).astype("<u4")
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0).take(pa.array(docs)), pa.array(sizes[docs]), pa.array(start), pa.array(lengths), raw,
                     pa.array(level.astype(np.int32)), pa.array(np.full(len(docs), part, np.int32)), pa.array(idx)],
                    ["doc_id", "doc_tokens", "start", "length", "ids", "level", "part", "idx"])
    return cut


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, ids (little-endian uint32), sequence_id, offset.

    ``max_len`` is a power of two.  Null and empty texts give one piece holding
    the end id; null ids and rows that repeat an id are packed like any others
    (each row on its own); very long texts are cut into full pieces; an empty
    table gives no rows.  Only ``doc_id`` and ``text`` are read, so other
    columns may have any name.  Reruns give the same ids, whatever the partitioning.

    One shuffle: documents are range-partitioned by id, tokenized in place and
    written to a scratch table; sequence ids then come from running counts per
    (bucket, partition), a table of at most 11 rows per shuffle partition.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship_package(docs.sparkSession)
    cut = _cutter(tokenizer or default_tokenizer(), max_len, end_id)
    pieces = saved(in_id_order(id_text(docs)).mapInArrow(cut, _SCHEMA), "pieces")
    counts = pieces.groupBy("level", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.groupBy("level").agg(F.sum("n").alias("total"))
    longer = levels.select(F.col("level").alias("up"), "total")
    base = (levels.select("level").join(F.broadcast(longer), F.col("up") > F.col("level"), "left")
            .groupBy("level").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("base")))
    offsets = (counts.join(F.broadcast(base), "level")
               .select("level", "part", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first")))
    # bounded: one row per (piece length, shuffle partition)
    return (pieces.join(F.broadcast(offsets), ["level", "part"])
            .select("doc_id", "doc_tokens", "start", "length", "ids",
                    (F.col("first") + F.col("idx")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
