"""Nested lecture JSON: line scan, nesting writer, tree flatten, gates, sections.

Flattening parses each line once, in place (no shuffle, no checkpoint), with the
rules of the standard JSON parser.  Rules (see README, "nested lectures"):

* only objects *inside a list* can be lectures; a lecture is an object that has
  both ``content`` and ``lecture_url`` keys (key presence, a JSON null counts);
* a lecture is terminal; a non-lecture object in a list is descended into and
  keeps the list's path; a list directly inside a list and scalars are skipped;
* an object's children get ``path > key``; the root path is ``ROOT``;
* metadata: ``title`` (default ``NoTitle``), ``url`` from ``lecture_url``
  (default ``NoURL``), ``path`` = stored ``path`` key, else the walk path;
* a lecture whose ``content`` is not a string (e.g. JSON null) is quarantined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.text import py_strip
from lectern.functions.fixed import LECTURE_FIELDS, NO_TITLE, NO_URL, SECTION_TITLE, SECTION_URL
from lectern.operators.blocks import text_slices


# --------------------------------------------------------------------------- A1
@F.pandas_udf(T.BooleanType())
def _loads(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and _parsed(t)[0])


def _parsed(text: str):
    """(whether the line is JSON, its value): last of duplicate keys wins, NaN and Infinity are numbers."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def classify_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """A1: status in {blank, invalid, valid}; ``value`` is the parsed VARIANT for valid lines.

    Lines are stripped of Unicode whitespace first.  A line that has no VARIANT
    form (duplicate keys, NaN, a string beyond the VARIANT size) is shown to the
    standard parser, and is valid with a null ``value`` where that accepts it;
    only such lines reach Python.
    """
    s = df.withColumn("_stripped", py_strip(F.col(line)))          # strip once, reuse
    blank = F.col("_stripped").isNull() | (F.col("_stripped") == F.lit(""))
    v = F.try_parse_json(F.col("_stripped"))
    s = s.withColumn("value", F.when(~blank, v))
    refused = F.when(~blank & F.col("value").isNull(), F.col("_stripped"))
    return (s.withColumn("_ok", F.col("value").isNotNull() | F.coalesce(_loads(refused), F.lit(False)))
            .withColumn("status", F.when(blank, F.lit("blank")).when(F.col("_ok"), F.lit("valid")).otherwise(F.lit("invalid")))
            .drop("_stripped", "_ok"))


def scan_jsonl(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A1 on files: (valid rows, quarantine rows).

    Lines are ordered by ``(file_path, block_start, pos)``: the file, the start of
    its split and the row's position within the split (``pos`` is increasing
    within a split), so quarantined lines can be traced back to their file."""
    raw = (spark.read.text(path)
           .select(F.col("value").alias("line"),
                   F.col("_metadata.file_path").alias("file_path"),
                   F.col("_metadata.file_block_start").alias("block_start"),
                   F.monotonically_increasing_id().alias("pos")))
    c = classify_lines(raw)
    valid = c.where(F.col("status") == "valid")
    quarantine = c.where(F.col("status") == "invalid").select("file_path", "block_start", "pos", "line")
    return valid, quarantine


# --------------------------------------------------------------------------- K3
def nest_lectures(lectures: DataFrame, *, max_per_line: int = 1000, order: str = "doc_id") -> DataFrame:
    """K3: lecture rows -> JSON lines ``{category: {section: [lecture, ...]}}``.

    A line holds at most ``max_per_line`` lectures of one section (block =
    ``order // max_per_line``), so a hot category or section never becomes one
    huge row.  Lectures keep ``order`` inside a line.
    """
    lec = lectures.select(
        "category", "section", F.col(order).alias("_ord"),
        F.floor(F.col(order) / max_per_line).alias("_block"),
        F.struct(*[F.col(f) for f in LECTURE_FIELDS]).alias("_lec"))
    grouped = lec.groupBy("category", "section", "_block").agg(
        F.array_sort(F.collect_list(F.struct("_ord", "_lec"))).alias("_items"))
    body = F.create_map(F.col("category"),
                        F.create_map(F.col("section"), F.transform("_items", lambda x: x["_lec"])))
    return grouped.select("category", "section", F.col("_block").alias("block"),
                          F.to_json(body).alias("line"))


# --------------------------------------------------------------------------- B2-B4
def has_key(v: Column, key: str) -> Column:
    """Key presence (a JSON null value counts as present)."""
    return F.variant_get(v, f"$.{key}", "variant").isNotNull()


def index_gate(v: Column) -> Column:
    """B2: lecture for indexing = object with ``content`` and ``lecture_url`` keys
    (a path lookup on a non-object is null, so no type test is needed)."""
    return has_key(v, "content") & has_key(v, "lecture_url")


def synth_gate(v: Column) -> Column:
    """Lecture for Q&A synthesis additionally needs ``title``."""
    return index_gate(v) & has_key(v, "title")


# --------------------------------------------------------------------------- B1
def flatten_lectures(lines: DataFrame, *, line: str = "line", keys: list[str] | None = None,
                     root: str = "ROOT") -> tuple[DataFrame, DataFrame]:
    """B1: walk JSON lines -> (documents, quarantine), at any depth.

    ``keys`` are carried through (e.g. line ordinal).  Documents have
    ``keys + (walk_path, title, url, path, content)``, the quarantine
    ``keys + (walk_path, raw)``: lectures whose content is not text, and lines
    that are not JSON (``walk_path`` null).  Both are narrow views of the
    one-pass walk, so output partitions are those of the input.
    """
    keys = keys or []
    flat = flatten_lectures_ordered(lines, line=line, keys=keys, root=root)
    return (flat.where("status = 'ok'").select(*keys, "walk_path", "title", "url", "path", "content"),
            flat.where("status <> 'ok'").select(*keys, "walk_path", "raw"))


def drop_placeholders(docs: DataFrame, placeholder: str) -> DataFrame:
    """Drop documents whose content is the not-found placeholder."""
    return docs.where(F.col("content") != F.lit(placeholder))


# --------------------------------------------------------------------------- B5, B6
def top_category(df: DataFrame, line: str = "line") -> DataFrame:
    """First key of the line's top object, in source order (null when none)."""
    keys = F.json_object_keys(py_strip(F.col(line)))
    return df.withColumn("top_category", F.get(keys, 0))


def category_filter(df: DataFrame, allowed: DataFrame, *, name: str = "name",
                    allowed_col: str = "category") -> DataFrame:
    """Exact match of the stripped name against an allow-list (semi join; the optimizer broadcasts a list that is small)."""
    return (df.withColumn("_key", py_strip(F.col(name)))
            .join(allowed.select(F.col(allowed_col).alias("_key")), "_key", "left_semi")
            .drop("_key"))


# --------------------------------------------------------------------------- G1, G2, G8
def section_text(lectures: DataFrame, *, list_keys: list[str], order: str = "doc_id") -> DataFrame:
    """G1 + G2 per list: ``"\\nTitle: t\\nURL: u\\ncontent\\n"`` concatenated in list order,
    and the sorted distinct ``"title (url)"`` references.  Lists are bounded units
    (one list of one line), never a whole category."""
    piece = F.concat(F.lit(SECTION_TITLE), F.col("title"), F.lit(SECTION_URL), F.col("url"),
                     F.lit("\n"), F.col("content"), F.lit("\n"))
    ref = F.concat(F.col("title"), F.lit(" ("), F.col("url"), F.lit(")"))
    return (lectures.withColumn("_piece", piece).withColumn("_ref", ref)
            .groupBy(*list_keys)
            .agg(F.count(F.lit(1)).alias("n_lectures"),
                 F.expr(f"listagg(_piece, '') WITHIN GROUP (ORDER BY {order})").alias("section_text"),
                 F.array_sort(F.collect_set("_ref")).alias("references")))


def section_merge(docs: DataFrame, *, category: str = "category", path: str = "path") -> DataFrame:
    """Lectures of the same section name (last path element) merged across depths.

    Returns counts per merged section (partial aggregation; no list is built)."""
    last = F.element_at(F.split(F.col(path), " > "), -1)
    return (docs.withColumn("section", last).groupBy(category, "section")
            .agg(F.count(F.lit(1)).alias("n_lectures"), F.count_distinct(path).alias("n_paths")))


# --------------------------------------------------------------------------- B1 ordered mode
ORDERED_SCHEMA = ("item_no long, list_ord long, walk_path string, title string, url string, path string, "
                  "content string, status string, raw string")
#: Bytes of lines that are parsed before their rows are handed on (one line at least).
FLATTEN_BLOCK = 1 << 22


def _as_text(v):
    """Text of a JSON value; half of a surrogate pair, which UTF-8 cannot hold, becomes U+FFFD."""
    if v is None:
        return None
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _walk_line(obj, root: str | None, need_title: bool = False):
    """Lectures of one parsed line in document order (iterative, insertion order kept).

    Returns ``(walk_path, lecture, list_ord)`` where ``list_ord`` is the post-order
    position of the list holding the lecture: a list is finished after every list
    nested inside it, which is the order in which the synthesis step consumes lists.
    """
    out, post, next_list = [], {}, 0
    stack = [("node", obj, root, None)]
    while stack:
        kind, node, path, list_id = stack.pop()
        if kind == "lec":
            out.append((path, node, list_id))
            continue
        if kind == "exit":
            post[node] = len(post)
            continue
        if isinstance(node, dict):
            stack.extend(reversed([("node", v, f"{path} > {k}" if path else str(k), list_id)
                                   for k, v in node.items()]))
        elif isinstance(node, list):
            lid, next_list = next_list, next_list + 1
            children = []
            for item in node:
                if isinstance(item, dict):
                    is_lec = "content" in item and "lecture_url" in item and (not need_title or "title" in item)
                    children.append(("lec" if is_lec else "node", item, path, lid))
            stack.append(("exit", lid, None, None))
            stack.extend(reversed(children))
    return [(p, item, post[lid]) for p, item, lid in out]


def flatten_lectures_ordered(lines: DataFrame, *, line: str = "line", keys: list[str] | None = None,
                             root: str = "ROOT", mode: str = "index") -> DataFrame:
    """B1, ordered mode: one pass per line with the standard JSON parser.

    Keeps dict insertion order and last-wins duplicate keys, and numbers the
    lectures of a line in walk order (``item_no``) and their lists in processing
    order (``list_ord``, post-order).  ``mode="index"`` walks the whole line from
    ``root``; ``mode="synthesis"`` walks only the first top-level key with paths
    starting at that category, needs ``title`` on lectures, and quarantines a
    line that is not an object.  ``status`` is ``ok``, ``quarantine`` (content
    not a string, or a non-object line in synthesis mode) or ``invalid`` (not
    JSON; one row, other fields null).  ``raw`` holds what was quarantined, as
    JSON, or the invalid line.  Blank lines produce no rows.
    """
    if mode not in ("index", "synthesis"):
        raise ValueError("mode must be 'index' or 'synthesis'")
    keys = keys or []
    src = lines.select(*keys, F.col(line).alias("_line"))
    key_fields = [f for f in src.schema.fields if f.name != "_line"]
    schema = T.StructType(key_fields + list(T._parse_datatype_string(ORDERED_SCHEMA).fields))
    types = to_arrow_schema(schema)
    synth = mode == "synthesis"
    empty = [None] * 7

    def rows_of(text: str) -> list:
        valid, obj = _parsed(text)
        if not valid:
            return [empty + ["invalid", text]]
        if not synth:
            walked = _walk_line(obj, root)
        elif not isinstance(obj, dict):
            return [empty + ["quarantine", text]]
        elif not obj:
            return []
        else:
            first = next(iter(obj))
            walked = _walk_line(obj[first], str(first), need_title=True)
        out = []
        for i, (wpath, item, list_ord) in enumerate(walked):
            content = item.get("content")
            ok = isinstance(content, str)
            out.append([i, list_ord, _as_text(wpath), _as_text(item.get("title", NO_TITLE)),
                        _as_text(item.get("lecture_url", NO_URL)), _as_text(item.get("path", wpath)),
                        _as_text(content) if ok else None, "ok" if ok else "quarantine",
                        None if ok else _as_text(item)])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, len(keys), size=FLATTEN_BLOCK):
                at, rows = [], []
                for i, text in enumerate(some.column(len(keys)).to_pylist()):
                    text = (text or "").strip()
                    if text:
                        found = rows_of(text)
                        rows.extend(found)
                        at.extend([i] * len(found))
                if rows:
                    kept = [some.column(j).take(pa.array(at, pa.int64())) for j in range(len(keys))]
                    made = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(types)[len(keys):])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept + made, types)], schema=types)

    return src.mapInArrow(run, schema=schema)
