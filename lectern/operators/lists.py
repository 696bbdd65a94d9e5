"""Lecture lists by their place in the input, and section texts in pieces of bounded size.

A list is one list of one input line.  Its identity is an ordinal path, not a
range of ids: the category's line, the section's place in it, and the item's
place in the list, all by first appearance in the input order.  Texts of a list are
concatenated in segments of bounded bytes, so neither a hot section nor a
long lecture run becomes one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import LECTURE_FIELDS, SECTION_TITLE, SECTION_URL
from lectern.operators.ordered import running_sum

#: Bytes of a segment of text, and of a nested line.
SEGMENT_BYTES, LINE_BYTES = 1 << 20, 32 << 20


def number_lists(lectures: DataFrame, *, order: str = "doc_id") -> DataFrame:
    """``lectures`` (category, section, ``order``, ...) with line_no, list_ord and item_no, each from 0.

    Lines and lists are few (one row per category, one per section of a
    category); items are numbered by running counts over ranges of ``order``, so a list
    that holds a third of all lectures is spread.  Null categories and sections are values of their own.
    """
    keys = ["category", "section"]
    lists = lectures.groupBy(*keys).agg(F.min(order).alias("_first"))
    lines = lists.groupBy("category").agg(F.min("_first").alias("_line"))
    lines = lines.withColumn("line_no", F.row_number().over(Window.orderBy("_line", "category")) - 1).select(F.col("category").alias("_c"), "line_no")
    in_line = Window.partitionBy("category").orderBy("_first", "section")
    lists = lists.withColumn("list_ord", F.row_number().over(in_line) - 1).join(lines, F.col("category").eqNullSafe(F.col("_c")))
    lists = lists.select(F.col("category").alias("_c"), F.col("section").alias("_s"), F.col("line_no").cast("long").alias("line_no"), F.col("list_ord").cast("long").alias("list_ord"))
    placed = lectures.join(F.broadcast(lists), F.col("category").eqNullSafe(F.col("_c")) & F.col("section").eqNullSafe(F.col("_s"))).drop("_c", "_s")
    return running_sum(placed.withColumn("_one", F.lit(1)), keys=["line_no", "list_ord"], order=order, value="_one", out="item_no", sparse=True).drop("_one")


def lecture_piece():
    """Text of one lecture in its section's text (G1)."""
    return F.concat(F.lit(SECTION_TITLE), F.col("title"), F.lit(SECTION_URL), F.col("url"), F.lit("\n"), F.col("content"), F.lit("\n"))


def section_segments(numbered: DataFrame, *, order: str = "doc_id", limit: int = SEGMENT_BYTES) -> DataFrame:
    """G1 per list in bounded rows: (category, section, line_no, list_ord, seg_no, first_item, n_lectures, text).

    A list's text is the texts of its segments one after the other.  A lecture
    belongs to the segment in which its text begins, so a segment holds less than
    ``limit`` bytes before its last lecture.
    """
    keys = ["line_no", "list_ord"]
    p = numbered.select("category", "section", *keys, "item_no", order, lecture_piece().alias("_piece")).withColumn("_bytes", F.octet_length("_piece"))
    p = running_sum(p, keys=keys, order=order, value="_bytes", out="_before", sparse=True)
    p = p.withColumn("seg_no", F.floor(F.col("_before") / limit).cast("long"))
    return (p.groupBy("category", "section", *keys, "seg_no")
            .agg(F.min("item_no").alias("first_item"), F.count(F.lit(1)).alias("n_lectures"),
                 F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY item_no)").alias("text")))


def section_references(numbered: DataFrame) -> DataFrame:
    """G2 per list in rows: (line_no, list_ord, reference), each distinct ``title (url)`` once."""
    ref = F.concat(F.col("title"), F.lit(" ("), F.col("url"), F.lit(")"))
    return numbered.select("line_no", "list_ord", ref.alias("reference")).distinct()


def list_caps(numbered: DataFrame, *, per_list: int, per_category: int, total: int) -> DataFrame:
    """W2-W4 by lists of the input: the first lectures of each list, of each line among those, and of all, in input order.

    Only (line_no, list_ord, item_no) are ranked; texts are fetched for the rows that survive, by the caller.
    """
    own = numbered.where(F.col("item_no") < per_list)  # the rank in the list is its item number
    w = Window.partitionBy("line_no").orderBy("list_ord", "item_no")
    own = own.withColumn("category_rank", F.row_number().over(w)).where(F.col("category_rank") <= per_category)
    return own.orderBy("line_no", "list_ord", "item_no").limit(total)


def category_lines(numbered: DataFrame, *, order: str = "doc_id", limit: int = LINE_BYTES) -> DataFrame:
    """K3: (line_no, part_no, line): ``{category: {section: [lecture, ...], ...}}``, one line a category.

    Sections and lectures keep their input order.  A category of more than
    ``limit`` bytes of text goes on in further lines (part_no), cut between lectures.
    """
    lec = numbered.select("category", "section", "line_no", "list_ord", "item_no", F.struct(*LECTURE_FIELDS).alias("_lec"))
    lec = lec.withColumn("_bytes", F.octet_length(F.to_json("_lec")))
    per = lec.groupBy("line_no", "list_ord").agg(F.sum("_bytes").alias("_all"))
    w = Window.partitionBy("line_no").orderBy("list_ord").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_all").over(w), F.lit(0))).drop("_all")  # one row per list
    lec = running_sum(lec, keys=["line_no", "list_ord"], order="item_no", value="_bytes", out="_before", sparse=True).join(F.broadcast(per), ["line_no", "list_ord"])
    lec = lec.withColumn("part_no", F.floor((F.col("_base") + F.col("_before")) / limit).cast("long"))
    lists = (lec.repartition("category", "line_no", "part_no")  # for both groupings: texts are shuffled once
             .groupBy("category", "section", "line_no", "part_no", "list_ord")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "_lec"))), lambda x: x["_lec"]).alias("_items")))  # at most `limit` bytes
    lines = lists.groupBy("category", "line_no", "part_no").agg(F.array_sort(F.collect_list(F.struct("list_ord", "section", "_items"))).alias("_lists"))
    body = F.map_from_entries(F.transform("_lists", lambda x: F.struct(x["section"], x["_items"])))
    return lines.select("line_no", "part_no", F.to_json(F.create_map(F.col("category"), body)).alias("line"))


def merged_sections(docs: DataFrame, *, category: str = "category", path: str = "path", order: str = "doc_id", limit: int = SEGMENT_BYTES) -> DataFrame:
    """Lectures of one section name (the last element of the path) at any depth as one list, in input order.

    (category, section, seg_no, n_lectures, n_paths, titles, urls): the merged
    list in rows of less than ``limit`` bytes of text before their last lecture.
    """
    last = F.element_at(F.split(F.col(path), " > "), -1)
    m = docs.withColumn("section", last).withColumn("_bytes", F.octet_length(F.coalesce("content", F.lit(""))))
    m = running_sum(m, keys=[category, "section"], order=order, value="_bytes", out="_before", sparse=True)
    m = m.withColumn("seg_no", F.floor(F.col("_before") / limit).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "title", "url")))
    return (m.groupBy(category, "section", "seg_no").agg(F.count(F.lit(1)).alias("n_lectures"), F.count_distinct(path).alias("n_paths"), ordered.alias("_l"))
            .select(category, "section", "seg_no", "n_lectures", "n_paths", F.col("_l.title").alias("titles"), F.col("_l.url").alias("urls")))
