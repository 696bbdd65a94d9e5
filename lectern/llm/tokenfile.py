"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A block holds the documents of one stretch of ascending doc_id (null ids have
blocks of their own): a header, the doc_ids and the ends of the documents as
two Elias-Fano sequences, and the concatenated id array (2 or 4 bytes an id).
An Elias-Fano sequence of n values below u keeps the low ``log2(u/n)`` bits of
each value packed and the high bits in unary, with the position of every 256th
one sampled, so value i is found by a select within one sample: about
``2 + log2(u/n)`` bits a document instead of a 64-bit table.

Blocks are written as a Parquet table (one row per block; the payload is the
file image), because Spark's committed writer survives lost executors and
writes to any store that the cluster uses.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import id_text, in_id_order, lots
from lectern.llm.tokens import default_tokenizer, encoder
from lectern.session import ship_package

MAGIC = b"EFT1"
SAMPLE = 256
#: A block is closed once it holds this many ids (the last document is kept whole).
BLOCK_IDS = 1 << 18


class EliasFano:
    """Non-decreasing non-negative integers in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", np.zeros(0, "<u4"))
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = v & np.uint64((1 << width) - 1)
        bits = (low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits or not count:
            return np.zeros(count, np.uint64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8:(b + 7) // 8], bitorder="little")
        bits = bits[a % 8:a % 8 + b - a].reshape(count, self.low_bits).astype(np.uint64)
        return (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, reading only the bits after the last sampled one before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        nxt = self.samples[i // SAMPLE + 1] if i // SAMPLE + 1 < len(self.samples) else len(self.high) * 8 - 1
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[at // 8:int(nxt) // 8 + 1], bitorder="little")
        one = np.flatnonzero(bits[at % 8:])[i % SAMPLE] + at
        return (int(one) - i) << self.low_bits | int(self._low(i, 1)[0])

    def decode(self) -> np.ndarray:
        """All values as uint64."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits) | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, width, a, b, c = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        low, high = raw[at:at + a], raw[at + a:at + a + b]
        samples = np.frombuffer(raw, "<u4", c, at + a + b)
        return cls(n, width, low, high, samples), at + a + b + 4 * c


def write_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """File image of one block; doc_ids ascend, or all are null."""
    null = doc_ids[0] is None
    base = 0 if null else doc_ids[0]
    flat = np.concatenate(ids)
    names = EliasFano.encode(np.array([] if null else [d - base for d in doc_ids], dtype=np.uint64))
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids]))
    head = MAGIC + struct.pack("<BBqQQ", flat.dtype.itemsize, null, base, len(ids), len(flat))
    return head + names.to_bytes() + ends.to_bytes() + flat.tobytes()


class Block:
    """A parsed block: ``doc(i)`` gives one document's ids without reading the others."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token block")
        width, self.null, self.base, self.n_docs, n_ids = struct.unpack_from("<BBqQQ", raw, 4)
        self.names, at = EliasFano.from_bytes(raw, 4 + struct.calcsize("<BBqQQ"))
        self.ends, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at)

    def doc(self, i: int) -> tuple[int | None, np.ndarray]:
        start = self.ends.select(i - 1) if i else 0
        return (None if self.null else self.base + self.names.select(i)), self.ids[start:self.ends.select(i)]

    def index(self) -> tuple[list[int | None], np.ndarray]:
        """(doc_ids, ends) of the whole block."""
        ids = [None] * self.n_docs if self.null else [self.base + int(x) for x in self.names.decode()]
        return ids, self.ends.decode().astype(np.int64)


def _writer(path: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "n_docs": len(ids), "n_ids": held, "payload": write_block(names, ids)}],
                pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                           ("payload", pa.binary())]))
        for batch in batches:
            for sub in lots(batch, 1):
                for doc_id, raw in zip(sub.column(0).to_pylist(), enc.encode_many(sub.column(1).to_pylist())):
                    if names and (held >= block_ids or (names[-1] is None) != (doc_id is None)
                                  or (doc_id is not None and doc_id - names[0] >= 1 << 62)):
                        yield block()
                        names, ids, held, seq = [], [], 0, seq + 1
                    names.append(doc_id)
                    ids.append(np.append(np.frombuffer(raw, enc.dtype), enc.dtype.type(end_id)))
                    held += len(ids[-1])
        if names:
            yield block()
    return write


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
                     block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id`` and write the blocks in ascending doc_id order.

    Null and empty texts are documents of the end id alone; null ids come
    first, rows that share an id are all written (ordered by a hash of their
    text); a very long text stays whole in its block; an empty table writes no
    block.  Only ``doc_id`` and ``text`` are read.  One shuffle (by id range).
    """
    ship_package(docs.sparkSession)
    write = _writer(tokenizer or default_tokenizer(), end_id, block_ids)
    (in_id_order(id_text(docs))
     .mapInArrow(write, "part int, seq int, n_docs long, n_ids long, payload binary")
     .write.parquet(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, first, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            block = Block(raw)
            names, ends = block.index()
            starts = np.concatenate([[0], ends[:-1]])
            wide = [block.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(wide, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``start`` counts all ids before it.

    A block's first id comes from running sums over the block table (without
    payloads): within a partition's blocks, and over one row per partition.
    """
    ship_package(spark)
    blocks = spark.read.schema("part int, seq int, n_docs long, n_ids long, payload binary").parquet(path)
    sizes = blocks.select("part", "seq", "n_ids")
    upto = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_part"))  # at most one row per shuffle partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n_part").over(whole), F.lit(0)).alias("base"))
    first = (sizes.join(F.broadcast(base), "part")
             .select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(upto), F.lit(0))).alias("first")))
    return (blocks.join(first, ["part", "seq"]).select("part", "seq", "first", "payload")
            .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary"))


def ids_crc32(ids: bytes) -> int:
    """The digest the query reports, for tests."""
    return zlib.crc32(ids)
