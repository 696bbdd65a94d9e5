"""Sinks K1-K8.  Writers go through the DataFrame writer (parallel, one file per
task); none collects rows to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_qa_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1 (overwrite) / K2 (append): QA records as JSON lines, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "append", col: str = "line") -> None:
    """K3: pre-rendered JSON lines (e.g. nested lectures) as text."""
    lines.select(col).write.mode(mode).text(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs rendered as JSON text (the CSV writer rejects them)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_eval_csv(df: DataFrame, out_dir: str, dataset: str = "dataset") -> None:
    """K4: one CSV set per dataset, folder ``eval_results_<label with '_' for ' '>``."""
    tagged = csv_ready(df).withColumn("eval_results", F.regexp_replace(F.col(dataset), " ", "_"))
    tagged.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("eval_results").csv(out_dir)


def write_text_report(report: DataFrame, path: str, col: str = "report") -> None:
    """K5: a small one-row text report (bounded size) as one file."""
    report.select(col).coalesce(1).write.mode("overwrite").text(path)


def metrics_json(counts: DataFrame, key: str = "category", value: str = "n") -> DataFrame:
    """K6: ``{category: count}`` as one JSON object (the category list is small)."""
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))
                      .alias("metrics"))


def write_index(chunks: DataFrame, path: str, overwrite: bool) -> None:
    """K7: index table; append adds rows again (no key, as the reference does)."""
    chunks.write.mode("overwrite" if overwrite else "append").parquet(path)


def document_json(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    """K8: one JSON object per chunk ``{page_content, metadata{title,url,path}}``."""
    return chunks.select(F.to_json(F.struct(F.col(text).alias("page_content"),
                                            F.struct("title", "url", "path").alias("metadata"))).alias("line"))
