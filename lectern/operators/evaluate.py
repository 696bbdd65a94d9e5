"""Evaluation: grade labels, per-dataset scores, examples, text report, rollups.

Scores are plain aggregations (partial aggregation before the shuffle), the
examples are ``row_number() <= n`` windows (``WindowGroupLimit``), and the
report text is assembled per dataset from those small results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import grade_label
from lectern.functions.fixed import (EXAMPLES_PER_LABEL, REPORT_ACCURACY, REPORT_CORRECT, REPORT_COUNTS, REPORT_EXAMPLE,
                                     REPORT_INCORRECT, REPORT_RULE, REPORT_TITLE)

SCORES = ("CORRECT", "INCORRECT", "UNKNOWN")


def with_score(df: DataFrame, reply: str = "grader_reply", out: str = "model_score") -> DataFrame:
    return df.withColumn(out, grade_label(reply))


def union_datasets(frames: list[tuple[str, DataFrame]], label_col: str = "dataset") -> DataFrame:
    """Bag union of labelled datasets (by column name)."""
    tagged = [df.withColumn(label_col, F.lit(label)) for label, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def accuracy(correct: Column, total: Column) -> Column:
    """correct / total, 0.0 for an empty dataset."""
    return F.coalesce(F.try_divide(correct.cast("double"), total.cast("double")), F.lit(0.0))


def percent_text(correct: Column, total: Column) -> Column:
    """Accuracy as ``12.34%`` from integer basis points (half-up), engine independent."""
    bp = F.when(total > 0, F.floor((correct * 20000 + total) / (total * 2))).otherwise(F.lit(0)).cast("long")
    return F.format_string("%d.%02d%%", (bp / 100).cast("long"), bp % 100)


def dataset_summary(scored: DataFrame, dataset: str = "dataset", score: str = "model_score",
                    datasets: DataFrame | None = None) -> DataFrame:
    """Total / correct / incorrect / unknown / accuracy per dataset.

    ``datasets`` (the small list of dataset labels) keeps datasets with no rows,
    reported with zero counts and accuracy 0.0."""
    s = F.col(score)
    agg = scored.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "CORRECT").alias("correct"),
        F.count_if(s == "INCORRECT").alias("incorrect"),
        F.count_if(s == "UNKNOWN").alias("unknown"))
    if datasets is not None:
        agg = datasets.select(dataset).distinct().join(agg, dataset, "left")
        agg = agg.select(dataset, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                    for c in ("total", "correct", "incorrect", "unknown")])
    return agg.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def label_examples(scored: DataFrame, n: int = EXAMPLES_PER_LABEL, *, dataset: str = "dataset",
                   score: str = "model_score", order: str = "row_id") -> DataFrame:
    """L2: first ``n`` rows per (dataset, label) in row order."""
    w = Window.partitionBy(dataset, score).orderBy(order)
    return scored.withColumn("example_no", F.row_number().over(w)).where(F.col("example_no") <= n)


def what_to_read(total: Column, incorrect: Column, unknown: Column) -> Column:
    """Closing lines of a report, from its counts: what has no grade, and what is graded incorrect."""
    return F.concat_ws("\n", F.when(unknown > 0, F.format_string("Without a grade: %d of %d rows; their replies name neither label.", unknown, total)),
                       F.when(incorrect > 0, F.format_string("Graded incorrect: %d of %d rows; the first are listed above.", incorrect, total)),
                       F.when((unknown == 0) & (incorrect == 0), F.format_string("All %d rows are graded correct.", total)))


def dataset_report(scored: DataFrame, *, dataset: str = "dataset", score: str = "model_score",
                   order: str = "row_id", question: str = "question", answer: str = "answer",
                   model_answer: str = "model_answer") -> DataFrame:
    """One text block per dataset (counts, accuracy, 3 correct and 3 incorrect examples)."""
    summ = dataset_summary(scored, dataset, score)
    ex = (label_examples(scored.where(F.col(score).isin("CORRECT", "INCORRECT")), dataset=dataset,
                         score=score, order=order)
          .withColumn("block", F.format_string(REPORT_EXAMPLE,
                                               F.coalesce(F.col(question), F.lit("")),
                                               F.coalesce(F.col(answer), F.lit("")),
                                               F.coalesce(F.col(model_answer), F.lit("")))))
    blocks = (ex.groupBy(dataset)
              .agg(F.expr(f"listagg(CASE WHEN {score} = 'CORRECT' THEN block END, '\\n') "
                          f"WITHIN GROUP (ORDER BY {order})").alias("ok_blocks"),
                   F.expr(f"listagg(CASE WHEN {score} = 'INCORRECT' THEN block END, '\\n') "
                          f"WITHIN GROUP (ORDER BY {order})").alias("bad_blocks")))
    j = summ.join(blocks, dataset, "left")
    lines = [
        F.format_string(REPORT_TITLE, F.col(dataset)),
        *[F.format_string(f"{name}: %d", F.col(c)) for name, c in zip(REPORT_COUNTS, ("total", "correct", "incorrect", "unknown"))],
        F.concat(F.lit(f"{REPORT_ACCURACY}: "), percent_text(F.col("correct"), F.col("total")), F.lit("\n")),
        F.lit(REPORT_CORRECT), F.lit(REPORT_RULE), F.coalesce(F.col("ok_blocks"), F.lit("")),
        F.lit(REPORT_INCORRECT), F.lit(REPORT_RULE), F.coalesce(F.col("bad_blocks"), F.lit("")),
        what_to_read(F.col("total"), F.col("incorrect"), F.col("unknown")), F.lit(""),
    ]
    return j.select(dataset, "total", "correct", "accuracy",
                    F.concat_ws("\n", *lines).alias("report"))


def combined_report(reports: DataFrame, dataset: str = "dataset") -> DataFrame:
    """K5: all dataset reports in label order, separated by a blank line (one row)."""
    return reports.agg(F.expr(f"listagg(report, '\\n\\n') WITHIN GROUP (ORDER BY {dataset})").alias("report"))


def score_rollup(scored: DataFrame, *cols: str, score: str = "model_score") -> DataFrame:
    """Totals and accuracy at every prefix of ``cols`` (ROLLUP)."""
    s = F.col(score)
    agg = scored.rollup(*cols).agg(F.count(F.lit(1)).alias("total"),
                                   F.count_if(s == "CORRECT").alias("correct"))
    return agg.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def counts_with_zeros(values: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Count per listed category, zero for listed categories with no rows.

    Counts are computed with a partial aggregation and joined to the list; the
    optimizer picks the join by size.
    """
    counts = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (categories.join(counts, key, "left")
            .select(key, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
