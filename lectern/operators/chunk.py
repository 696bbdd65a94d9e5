"""Markdown-aware character chunking (size 8096, overlap 200), as a narrow
``mapInArrow`` over documents, a bounded slice of a batch at a time; metadata columns are copied onto every chunk.

Contract (our own; the unit is characters):

1. separators in order: heading at line start, code fence, horizontal rules,
   blank line, newline, space, and finally a hard cut;
2. a span longer than ``size`` is split at every match of the first separator
   that occurs in it, the separator staying at the start of the following piece;
   pieces still longer than ``size`` are split with the remaining separators;
3. pieces are merged greedily up to ``size``; when the next piece does not fit,
   the chunk is emitted and a tail of whole pieces of at most ``overlap``
   characters (shortened further if tail + next piece would exceed ``size``)
   starts the next chunk;
4. chunks are stripped of Unicode whitespace, blanks dropped, numbered from 0.

Each chunk carries ``start``/``end`` offsets into the source text, so coverage
and order can be checked against the source on the Spark side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.text import PY_SPACE_CLASS, is_blank
from lectern.functions.fixed import CHUNK_OVERLAP, CHUNK_SIZE
from lectern.operators.blocks import text_slices


SEPARATORS = [r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", r" "]
_SEPS = [re.compile(s) for s in SEPARATORS]
# Python's str.strip() whitespace, used to trim chunk offsets
_WS = re.compile(r"[\s\x1c-\x1f]")


def _pieces(text: str, start: int, end: int, level: int, size: int, out: list[tuple[int, int]]) -> None:
    if end - start <= size:
        if end > start:
            out.append((start, end))
        return
    for li in range(level, len(_SEPS)):
        cuts = [m.start() for m in _SEPS[li].finditer(text, start, end) if m.start() > start]
        if cuts:
            bounds = [start] + cuts + [end]
            for a, b in zip(bounds[:-1], bounds[1:]):
                _pieces(text, a, b, li + 1, size, out)
            return
    for a in range(start, end, size):      # hard cut
        out.append((a, min(a + size, end)))


def split_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """Chunk spans ``(start, end)`` of ``text`` after merging and trimming."""
    pieces: list[tuple[int, int]] = []
    _pieces(text, 0, len(text), 0, size, pieces)
    raw: list[tuple[int, int]] = []
    cur: list[tuple[int, int]] = []
    cur_len = 0
    for p in pieces:
        plen = p[1] - p[0]
        if cur and cur_len + plen > size:
            raw.append((cur[0][0], cur[-1][1]))
            while cur and (cur_len > overlap or cur_len + plen > size):
                cur_len -= cur[0][1] - cur[0][0]
                cur.pop(0)
        cur.append(p)
        cur_len += plen
    if cur:
        raw.append((cur[0][0], cur[-1][1]))
    spans = []
    for a, b in raw:
        while a < b and _WS.match(text, a):
            a += 1
        while b > a and _WS.match(text, b - 1):
            b -= 1
        if b > a and (not spans or spans[-1] != (a, b)):
            spans.append((a, b))
    return spans


def chunk_documents(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None,
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Documents -> chunks ``keep + (chunk_no, start, end, chunk)`` (one row per chunk)."""
    keep = keep or [c for c in docs.columns if c != text]
    src = docs.select(*keep, F.col(text).alias("_text"))
    fields = [f for f in src.schema.fields if f.name != "_text"]
    schema = T.StructType(fields + [
        T.StructField("chunk_no", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("chunk", T.StringType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, len(fields)):
                row, cno, st, en, ch = [], [], [], [], []
                for at, t in enumerate(some.column(len(fields)).to_pylist()):
                    if t is None:
                        continue
                    for i, (a, b) in enumerate(split_spans(t, size, overlap)):
                        row.append(at)
                        cno.append(i)
                        st.append(a)
                        en.append(b)
                        ch.append(t[a:b])
                if row:
                    kept = [some.column(j).take(pa.array(row, pa.int64())) for j in range(len(fields))]
                    made = [pa.array(v, pa.int64()) for v in (cno, st, en)] + [pa.array(ch, pa.string())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept + made, types)], schema=types)

    return src.mapInArrow(run, schema=schema)


def chunk_invariants(docs: DataFrame, chunks: DataFrame, *, key: str = "doc_id", text: str = "text",
                     size: int = CHUNK_SIZE) -> DataFrame:
    """Per document: has_chunks, size_ok, order_ok, exact_ok, covered (checked against the source)."""
    w = Window.partitionBy(key).orderBy("chunk_no")
    c = (chunks.select(key, "chunk_no", "start", "end", "chunk")
         .withColumn("prev_start", F.lag("start").over(w))
         .withColumn("prev_end", F.lag("end").over(w)))
    j = c.join(docs.select(key, F.col(text).alias("_t")), key)
    gap = F.when(F.col("start") > F.col("prev_end"),
                 F.substr(F.col("_t"), F.col("prev_end") + 1, F.col("start") - F.col("prev_end")))
    per = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.max(F.length("chunk")).alias("max_len"),
        F.count_if(F.col("prev_start").isNotNull() & (F.col("start") <= F.col("prev_start"))).alias("bad_order"),
        F.count_if(F.substr(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("chunk"))
        .alias("bad_exact"),
        F.count_if(gap.isNotNull() & ~is_blank(gap)).alias("bad_gap"),
        F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    d = docs.select(key, F.col(text).alias("_t"))
    lead_ws = F.length("_t") - F.length(F.regexp_replace("_t", rf"\A{PY_SPACE_CLASS}+", ""))
    trail_ws = F.length("_t") - F.length(F.regexp_replace("_t", rf"{PY_SPACE_CLASS}+\z", ""))
    r = d.join(per, key, "left")
    has = F.col("n_chunks").isNotNull()
    return r.select(
        key,
        has.alias("has_chunks"),
        F.coalesce(F.col("max_len") <= size, F.lit(True)).alias("size_ok"),
        F.coalesce(F.col("bad_order") == 0, F.lit(True)).alias("order_ok"),
        F.coalesce(F.col("bad_exact") == 0, F.lit(True)).alias("exact_ok"),
        F.when(has, (F.col("bad_gap") == 0) & (F.col("first_start") == lead_ws)
               & (F.col("last_end") == F.length("_t") - trail_ws)).otherwise(is_blank("_t")).alias("covered"))
