"""Streaming queries: each writes its input files from the driver tables (by Spark),
runs the stream to completion with ``availableNow`` and returns the sink's content."""

from __future__ import annotations

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lectern.functions.text import PY_SPACE_CLASS
from lectern.operators import cells as X
from lectern.operators import html as H
from lectern.operators.embed import term_embedder
from lectern.plans.chat import HISTORY_SQL
from lectern.plans.chunks import INDEX_CTES
from lectern.plans.html import NONBLANK_LINKS_SQL, pages_clean
from lectern.plans.io import scratch
from lectern.plans.nested import nested_lines
from lectern.plans.registry import Tables, register
from lectern.plans.sqlparts import LECTURES, q, strip
from lectern.streaming import ingest as S
from lectern.streaming import stateful as T


def _run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _deal(parts, write, src) -> int:
    """Writes ``parts`` below ``src`` one after the other, each by as many tasks as it has; the number of files of a
    micro-batch that takes as much as the largest part.  Streams read files in the order of their times."""
    files, most = 0, 1
    for part in parts:
        write(part.write.mode("append"), src)
        n = len(part.sparkSession.read.text(src).inputFiles())
        files, most = n, max(most, n - files)
    return most


@register("stream_ingest", f"""
SELECT url, title, category || ' > ' || section AS path,
       length(regexp_replace(content, {q(PY_SPACE_CLASS + "+\\z")}, '', 'g')) AS n_chars
FROM {LECTURES} WHERE {strip('content')} <> ''
""")
def stream_ingest(spark, sf):
    """Nested JSONL files streamed into the index (flatten, chunk, strip diacritics).

    Per document the end offset of the last chunk is returned: the text is indexed
    up to its last non-space character.
    """
    base = scratch(spark, "stream-ingest")
    lines = nested_lines(Tables(spark, sf))
    half = F.col("block") % 2 == 0            # two files -> two input files for the stream
    src = base + "/src"
    lines.where(half).select("line").write.text(src)
    lines.where(~half).select("line").write.mode("append").text(src)
    _run(S.start_ingest(spark, src, base + "/index", base + "/ckpt"))
    idx = spark.read.parquet(base + "/index")
    per = idx.groupBy("url", "title", "path").agg(F.max("end").alias("n_chars"))
    return per.select("url", "title", "path", F.col("n_chars").cast("long").alias("n_chars"))


@register("stream_history", f"""
SELECT conv_id, turn, n_pairs, history_chars FROM {HISTORY_SQL}
""")
def stream_history(spark, sf):
    """applyInPandasWithState over the conversation log equals the batch history window."""
    base = scratch(spark, "stream-history")
    conv = Tables(spark, sf).conversations
    conv.write.json(base + "/src")
    _run(S.start_history(spark, base + "/src", base + "/out", base + "/ckpt",
                         "conv_id long, turn long, role string, text string"))
    return spark.read.parquet(base + "/out").select("conv_id", "turn", "n_pairs", "history_chars")


@register("stream_dedup", f"SELECT DISTINCT href FROM {NONBLANK_LINKS_SQL}")
def stream_dedup(spark, sf):
    """S3: streaming de-duplication of harvested link URLs."""
    base = scratch(spark, "stream-dedup")
    H.link_rows(pages_clean(Tables(spark, sf))).select("page_id", "link_no", "href").write.json(base + "/src")
    _run(S.start_url_dedup(spark, base + "/src", base + "/out", base + "/ckpt",
                           "page_id long, link_no long, href string"))
    return spark.read.parquet(base + "/out").select("href")


@register("stream_history_any_order", f"SELECT conv_id, turn, n_pairs, history_chars FROM {HISTORY_SQL}")
def stream_history_any_order(spark, sf):
    """S2 with the turns of every conversation dealt over three micro-batches, later ones first."""
    base = scratch(spark, "stream-any-order")
    conv = Tables(spark, sf).conversations
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    files = _deal([conv.where(part == i) for i in (2, 0, 1)], DataFrameWriter.json, base + "/src")
    _run(T.start_history_any_order(spark, base + "/src", base + "/out", base + "/ckpt", "conv_id long, turn long, role string, text string", files_per_batch=files))
    return spark.read.parquet(base + "/out").select("conv_id", "turn", "n_pairs", "history_chars")


@register("stream_dedup_bounded", f"SELECT DISTINCT href FROM {NONBLANK_LINKS_SQL}")
def stream_dedup_bounded(spark, sf):
    """S3 with state that is dropped after each of two micro-batches, and the table of addresses seen."""
    base = scratch(spark, "stream-bounded")
    links = H.link_rows(pages_clean(Tables(spark, sf))).select("page_id", "href")
    half = F.expr("percentile_approx(page_id, 0.5)")
    middle = links.agg(half).first()[0] or 0
    files = _deal([links.where(F.col("page_id") <= middle), links.where(F.col("page_id") > middle)], DataFrameWriter.json, base + "/src")
    _run(T.start_url_dedup_bounded(spark, base + "/src", base + "/out", base + "/ckpt", "page_id long, href string", delay="0 seconds", files_per_batch=files))
    return T.seen_links(spark, base + "/out", "page_id long, href string").select("href")


@register("stream_index", f"""
WITH RECURSIVE {INDEX_CTES}
SELECT url, title, category || ' > ' || section AS path, chunk_no, md5(text) AS text_md5, len(list_filter(vec, lambda x: x > 0)) AS n_places
FROM entry JOIN entry_vec USING (doc_id, chunk_no) JOIN {LECTURES} l USING (doc_id)
""")
def stream_index(spark, sf):
    """S1 + K7: nested JSONL streamed into the cell index in two micro-batches, with vectors."""
    base = scratch(spark, "stream-index")
    lines = nested_lines(Tables(spark, sf))
    half = F.pmod(F.xxhash64("category", "section"), F.lit(2))
    files = _deal([lines.where(half == odd).select("line") for odd in (0, 1)], DataFrameWriter.text, base + "/src")
    _run(T.start_index_ingest(spark, base + "/src", base + "/index", base + "/ckpt", term_embedder(), cells=8, files_per_batch=files))
    rows = X.read_index(spark, base + "/index")
    return rows.select("url", "title", "path", "chunk_no", F.md5("text").alias("text_md5"), F.size(F.filter("vec", lambda x: x > 0)).alias("n_places"))
