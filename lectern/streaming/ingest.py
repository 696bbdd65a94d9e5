"""Structured Streaming: incremental ingest into the index, per-conversation
history state, and streaming URL de-duplication.

All streams checkpoint under the shared folder, so a restarted query resumes
from its last committed offsets; the index sink is idempotent per batch id
(a batch folder is overwritten, never appended twice).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.text import strip_diacritics
from lectern.operators import chunk as CH
from lectern.operators import nested as N


def index_batch(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch body of the index build: flatten -> chunk -> strip diacritics (after chunking).

    Returns (chunks, quarantine): quarantine holds (reason, raw) of lines that do not
    parse and of lectures whose content is not text."""
    docs, bad = N.flatten_lectures(lines)
    reason = F.when(F.col("walk_path").isNull(), F.lit("invalid line")).otherwise(F.lit("content is not text"))
    quarantine = bad.select(reason.alias("reason"), "raw")
    chunks = CH.chunk_documents(docs.select("title", "url", "path", F.col("content").alias("text")),
                                keep=["title", "url", "path"])
    return chunks.withColumn("page_content", strip_diacritics(F.col("chunk"))).drop("chunk"), quarantine


def start_ingest(spark: SparkSession, source_dir: str, index_dir: str, checkpoint: str, quarantine_dir: str | None = None):
    """JSONL files -> index table, one folder per micro-batch (idempotent on replay).

    What cannot be indexed is written the same way to ``quarantine_dir`` (default: beside the index)."""
    quarantine_dir = quarantine_dir or f"{index_dir.rstrip('/')}-quarantine"
    lines = spark.readStream.format("text").load(source_dir).withColumnRenamed("value", "line")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        chunks, quarantine = index_batch(batch)
        quarantine.write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")
        chunks.write.mode("overwrite").parquet(f"{index_dir}/batch={batch_id}")

    return (lines.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


HISTORY_SCHEMA = "conv_id long, turn long, n_pairs long, history_chars long"
HISTORY_STATE = "n_pairs long, chars long, last_role string, last_text string"


def _history_fn_factory(idle_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:              # conversation idle: drop its state, emit nothing
            state.remove()
            return
        n_pairs, chars, last_role, last_text = state.get if state.exists else (0, 0, None, None)
        rows = pd.concat(list(pdfs)).sort_values("turn")
        out_turn, out_n, out_c = [], [], []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            if role == "user":
                out_turn.append(int(turn))
                out_n.append(int(n_pairs))
                out_c.append(int(chars))
            elif role == "assistant" and last_role == "user":
                n_pairs += 1
                chars += len(f"User: {last_text}\nBot: {text}")
            last_role, last_text = role, text
        state.update((int(n_pairs), int(chars), last_role, last_text))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [int(key[0])] * len(out_turn), "turn": out_turn,
                            "n_pairs": out_n, "history_chars": out_c})
    return fn


def start_history(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, schema: str,
                  idle_timeout_ms: int | None = None, trigger_interval: str = "30 seconds"):
    """Per-conversation state (pairs so far, history size), one output row per user turn.

    Turns of a conversation must arrive in order across micro-batches (append-only log);
    within a batch they are sorted by turn.  State per conversation is four fields.

    Without ``idle_timeout_ms`` the query processes what is available and stops
    (``availableNow``).  With it, the query runs as a service on a processing-time
    trigger and removes the state of a conversation idle for that long, which
    bounds state by the active conversations (timeouts need the engine to keep
    scheduling batches, so they cannot be combined with ``availableNow``)."""
    conv = spark.readStream.schema(schema).json(source_dir)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_ms else GroupStateTimeout.NoTimeout
    out = conv.groupBy("conv_id").applyInPandasWithState(
        _history_fn_factory(idle_timeout_ms), outputStructType=HISTORY_SCHEMA, stateStructType=HISTORY_STATE,
        outputMode="append", timeoutConf=timeout)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(processingTime=trigger_interval) if idle_timeout_ms else w.trigger(availableNow=True)
    return w.start()


def start_url_dedup(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, schema: str,
                    key: str = "href"):
    """S3: first sighting of each URL.  Without event time the key state is unbounded
    (one entry per distinct URL), which is what exact de-duplication needs."""
    links = spark.readStream.schema(schema).json(source_dir)
    return (links.dropDuplicates([key]).writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
