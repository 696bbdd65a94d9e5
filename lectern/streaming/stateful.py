"""Streams whose state is bounded or whose input comes out of order, and an index that grows batch by batch.

* history: turns of a conversation may arrive in any order; those that are
  ahead wait in map state, a timer gives up on conversations that stay silent;
* links: the state holds the addresses of the watermark's last stretch only, older
  ones are found in the table of addresses seen;
* index: chunks, vectors and quarantine of a micro-batch become visible with its manifest row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import cells as X
from lectern.operators.embed import embed
from lectern.operators.provider import Provider
from lectern.streaming.ingest import HISTORY_SCHEMA, index_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -- S2 ---------------------------------------------------------------------

class History(StatefulProcessor):
    """Pairs and characters of the history before each user turn; turns count from 0 without gaps.

    State: the next turn, the counts so far and the last turn as one value, and
    the turns that came early as a map from their number.  A turn that was seen already is ignored.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "next long, n_pairs long, chars long, role string, text string")
        self.early = handle.getMapState("early", "turn long", "role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, n_pairs, chars, last_role, last_text = self.now.get() if self.now.exists() else (0, 0, 0, None, None)
        came: dict[int, tuple] = {}
        for pdf in rows:
            for turn, role, text in zip(pdf["turn"], pdf["role"], pdf["text"]):
                if turn >= nxt:
                    came.setdefault(int(turn), (role, text))
        out = []
        while True:
            if nxt in came:
                role, text = came.pop(nxt)
            elif self.early.containsKey((nxt,)):
                role, text = self.early.getValue((nxt,))
                self.early.removeKey((nxt,))
            else:
                break
            if role == "user":
                out.append((int(key[0]), nxt, n_pairs, chars))
            elif role == "assistant" and last_role == "user" and text is not None and last_text is not None:
                n_pairs += 1
                chars += len(f"User: {last_text}\nBot: {text}")
            last_role, last_text, nxt = role, text, nxt + 1
        for turn, said in came.items():
            if not self.early.containsKey((turn,)):
                self.early.updateValue((turn,), said)
        self.now.update((nxt, n_pairs, chars, last_role, last_text))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_pairs", "history_chars"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        self.early.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "n_pairs", "history_chars"])

    def close(self) -> None:
        pass


def start_history_any_order(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, schema: str, *,
                            files_per_batch: int | None = None, idle_ms: int | None = None, trigger_interval: str = "30 seconds"):
    """S2 for turns in any order over micro-batches: one row per user turn once all turns before it are there.

    Needs the RocksDB state store; the session's setting is put back after the query has started.  ``idle_ms`` drops a
    conversation that has been silent for so long (as a service; without it the query stops when nothing is left).
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        out = reader.json(source_dir).groupBy("conv_id").transformWithStateInPandas(
            statefulProcessor=History(idle_ms), outputStructType=HISTORY_SCHEMA, outputMode="append",
            timeMode="ProcessingTime" if idle_ms else "None")
        w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint).outputMode("append")
        return (w.trigger(processingTime=trigger_interval) if idle_ms else w.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# -- S3 ---------------------------------------------------------------------

def seen_links(spark: SparkSession, sink_dir: str, schema, but: str | None = None) -> DataFrame:
    """Rows of the batches written so far, without the batch ``but``."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(sink_dir)
    return df.where(~F.col("_metadata.file_path").contains(f"/{but}/")) if but else df


def start_url_dedup_bounded(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, schema: str, *, key: str = "href",
                            delay: str = "1 hour", files_per_batch: int | None = None):
    """S3 with bounded state: the first sighting of each address, for good.

    The watermark follows the time of arrival, so no row is ever late and dropped.  The state store holds
    addresses until it has passed them by ``delay``; what comes back later is found in
    the table written so far, by an anti-join on the key alone.  A batch's folder is replaced when the batch is run
    again, and it never meets itself.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    links = reader.json(source_dir).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay).dropDuplicatesWithinWatermark([key]).drop("_arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"batch={batch_id:08d}"
        fresh = batch.dropDuplicates([key])
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(sink_dir)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(seen_links(session, sink_dir, batch.schema, own).select(key), key, "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{sink_dir}/{own}")
    return links.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- S1 ---------------------------------------------------------------------

def index_micro_batch(lines: DataFrame, path: str, batch: str, provider: Provider, *, cells: int | None = None) -> int:
    """One micro-batch into the index of ``cells``: quarantine and chunks first, the manifest row last.

    A batch that broke off anywhere has no manifest row, is seen by no reader, and is written anew from the start.
    """
    if batch in X.committed(lines.sparkSession, path):
        return 0
    chunks, quarantine = index_batch(lines)
    rows = chunks.withColumnRenamed("page_content", "text").withColumn("doc_id", F.xxhash64("url", "title", "path"))
    quarantine.write.mode("overwrite").parquet(f"{path}/quarantine/batch={batch}")
    return X.write_index(embed(rows, provider), path, batch=batch, cells=cells)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(reason, raw, batch) of the visible micro-batches."""
    return (spark.read.schema("reason string, raw string, batch string").option("basePath", f"{path}/quarantine")
            .parquet(*[f"{path}/quarantine/batch={b}" for b in X.committed(spark, path)]))


def start_index_ingest(spark: SparkSession, source_dir: str, path: str, checkpoint: str, provider: Provider, *,
                       cells: int | None = None, files_per_batch: int | None = None):
    """JSONL files -> chunks with vectors in the cell index, a micro-batch at a time, each visible as a whole."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(source_dir).withColumnRenamed("value", "line")

    def write(batch: DataFrame, batch_id: int) -> None:
        index_micro_batch(batch, path, f"stream-{batch_id:08d}", provider, cells=cells)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
