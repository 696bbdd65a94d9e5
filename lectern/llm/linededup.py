"""Line de-duplication by overlapping three-line windows (DataFrame functions only).

Lines are the trimmed non-blank lines of a text, numbered from 0.  Every
window of three consecutive ones is hashed (128 bits); the first window of
each hash in (doc_id, position) order stays and every later one is covered.
Covered positions are merged per document and removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved, wide_hash

WINDOW = 3


def _text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _visible(lines: Column) -> Column:
    """(line, index in the text) of the non-blank lines, trimmed of ASCII white space."""
    trimmed = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line"), i.alias("at")))
    return F.filter(trimmed, lambda x: x["line"] != "")


def _row_key() -> list[Column]:
    """128 bits that stand for a row's id and text: texts that share an id, or have none, stay apart."""
    return [h.alias(f"k{i}") for i, h in enumerate(wide_hash(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))))]


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def windows(docs: DataFrame) -> DataFrame:
    """(k0, k1, doc_id, pos, h1, h2): hash of the three lines that start at each position of each row."""
    v = docs.select(*_row_key(), F.col("doc_id").cast("long").alias("doc_id"), _visible(_text_lines(F.col("text"))).alias("v"))
    v = v.where(F.size("v") >= WINDOW).select("k0", "k1", "doc_id", F.col("v.line").alias("v"))
    grams = F.transform(F.sequence(F.lit(0), F.size("v") - WINDOW),
                        lambda i: F.struct(i.alias("pos"), F.slice("v", i + 1, WINDOW).alias("w")))
    w = v.select("k0", "k1", "doc_id", F.explode(grams).alias("g"))
    h1, h2 = wide_hash(F.col("g.w"))
    return w.select("k0", "k1", "doc_id", F.col("g.pos").alias("pos"), h1.alias("h1"), h2.alias("h2"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """(k0, k1, gone): ascending positions covered by later occurrences of a window, merged per row.

    Where a later window overlaps the first one in the same row (a line
    repeated on and on), the first one's lines stay.
    """
    w = saved(windows(docs), "windows")  # 44 bytes a line, most of them the row's key, which Parquet keeps once a row
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1", "pos")
    first = (w.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("h1", "h2", "first"))  # pre-aggregated before the shuffle; only repeated windows go on
    j = w.join(first, ["h1", "h2"])
    same = (F.col("k0") == F.col("first.k0")) & (F.col("k1") == F.col("first.k1"))
    start = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    later = j.where(~same | (F.col("pos") > F.col("first.pos"))).select("k0", "k1", start.alias("a"), (F.col("pos") + WINDOW - 1).alias("b"))
    spans = later.where("a <= b").select("k0", "k1", F.explode(F.sequence("a", "b")).alias("p"))
    return spans.groupBy("k0", "k1").agg(F.array_sort(F.collect_set("p")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated three-line passages removed; all columns and rows stay.

    ``text`` loses the covered lines (null texts stay null, an emptied text is
    '').  ``n_removed`` counts them; a column of that name is replaced.  Texts
    of fewer than three visible lines are unchanged.  Rows with null ids come
    last in order, and rows that share an id (or have none) in the order of a hash of their text;
    each is a document of its own.  Only rows equal in id and text count as one, so
    a repeated row is not a later occurrence of itself.  Blank lines are
    skipped by windows and stay.  An empty table gives an empty table.  A text costs
    time in proportion to its lines.

    Shuffles: 44 bytes a line for the windows, then the texts once, joined to
    the covered positions of their row.  A passage that a third of all
    documents share is one key of a pre-aggregated count and then the skewed
    side of a join, which AQE splits.
    """
    gone = covered_lines(docs).select(F.col("k0").alias("__k0"), F.col("k1").alias("__k1"), F.col("gone").alias("__gone"))
    packed = docs.select(*[k.alias(f"__key{i}") for i, k in enumerate(_row_key())], F.struct("*").alias("__row"))
    j = packed.join(gone, (F.col("__key0") == F.col("__k0")) & (F.col("__key1") == F.col("__k1")), "left")

    def without(lines: Column) -> Column:
        """The runs of lines between removed ones, joined again."""
        def cut(drop: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.size(drop)), lambda i: _between(lines, drop, i))
            return F.array_join(F.flatten(runs), "\n")
        seen = _visible(lines)
        return _with(_with(seen, lambda v: F.transform(F.col("__gone"), lambda p: v[p]["at"])), cut)
    text = F.when(F.col("__gone").isNotNull(), _with(_text_lines(F.col("__row.text")), without)).otherwise(F.col("__row.text"))
    out = j.withColumn("__text", text).withColumn("__n", F.coalesce(F.size("__gone"), F.lit(0)))
    cols = [F.col("__text").alias(c) if c == "text" else F.col("__row").getField(c).alias(c)
            for c in docs.columns if c != "n_removed"]
    return out.select(*cols, F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.col("__n")).cast("long").alias("n_removed"))


def _between(lines: Column, drop: Column, i: Column) -> Column:
    """Lines after the removed line before place ``i`` and up to the one at it (lines and removed ones count from 0)."""
    before = F.when(i == 0, F.lit(-1)).otherwise(F.get(drop, i - 1))
    upto = F.when(i == F.size(drop), F.size(lines)).otherwise(F.get(drop, i))
    return F.slice(lines, before + 2, upto - before - 1)
