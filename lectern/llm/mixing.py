"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t has the golden-ratio point frac(t * phi); cumulative weights map it to
a source, and its rank among that source's slots picks the source's next
block.  Blocks are equal stretches of the source's documents, shuffled by a
hash and laid end to end (twice, since a source is used at most twice).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, saved

_SPACE = r"[\x20\x09-\x0D]"
_SPACES = " \t\n\v\f\r"

#: floor(2**32 / golden ratio): multiples of it modulo 2**32 are the golden-ratio points in exact integers.
GOLDEN = 2654435769
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of one source per window task, and slots per window task.
BUCKET_DOCS = 2_000
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), counted where each has become one letter: ``regexp_count`` holds all words of a text as an array."""
    letters = F.regexp_replace(F.rtrim(text, F.lit(_SPACES)), rf"{_SPACE}*+{WORD}+", "x")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], share: float, passes: float) -> list[float]:
    """Target words of each source: ``share`` of all words by the repeating weights; a source
    that reaches ``passes`` times its size stops there and the others share the excess by weight."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    left, open_, out = share * sum(n for _, n in sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if unit * weight[i] > passes * sizes[i][1]]
        if not full:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = float(passes * sizes[i][1])
            left -= out[i]
        open_ -= set(full)
    return out


def _shuffled(d: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds ``start``: words of the source's documents before this one in shuffled order.

    A source is dealt over hash ranges of bounded row counts, so a source that holds a third
    of all rows is many window tasks; one row per range carries the totals.
    """
    d = d.join(F.broadcast(buckets), "src")  # one row per source
    d = d.withColumn("part", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("parts")).cast("long"))
    inner = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    upto = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (d.groupBy("src", "part").agg(F.sum("size").alias("n"))
            .select("src", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")))
    return d.join(base, ["src", "part"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "parts", "part")


def schedule(spark, quotas: list[int], weights: list[float], n_slots: int) -> DataFrame:
    """(slot, src, rank) for ranks below the source's quota.

    A source that falls short of its quota within ``n_slots`` (the points are
    low-discrepancy, so by a few slots) gets its last ranks after the schedule.
    """
    total, upto, bounds = sum(weights), 0.0, []
    for w in weights[:-1]:
        upto += w
        bounds.append(int(upto / total * (1 << 32)))
    t = spark.range(n_slots).withColumnRenamed("id", "slot")
    u = (F.col("slot") % F.lit(1 << 30)) * F.lit(GOLDEN) % F.lit(1 << 32)
    src = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b <= F.col("u")))
    t = t.withColumn("u", u).select("slot", src.alias("src"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = t.groupBy("chunk", "src").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "src", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("chunk", "src").orderBy("slot")) - 1
    ranked = t.withColumn("inside", inside).join(base, ["chunk", "src"]).select("slot", "src", (F.col("base") + F.col("inside")).alias("rank"))
    quota = spark.createDataFrame(list(enumerate(quotas)), "src int, quota long")
    ranked = ranked.join(F.broadcast(quota), "src").where("rank < quota").drop("quota")
    have = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    tail = (quota.join(have, "src", "left").where("quota > coalesce(have, 0)")
            .select("src", F.explode(F.expr("sequence(coalesce(have, 0L), quota - 1)")).alias("rank")))
    return ranked.unionByName(tail.select((F.col("rank") * F.lit(len(quotas)) + F.col("src") + F.lit(n_slots)).alias("slot"), "src", "rank"))


class Mix:
    """A planned mix: sources with targets, documents with their place, and the block schedule."""

    def __init__(self, docs: DataFrame, share: float = 1.5, passes: int = 2, seed: int = 0, block: int | None = None,
                 max_slots: int = 1 << 20):
        spark = docs.sparkSession
        self.passes = passes
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
        name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        key = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
        d = saved(d.withColumn("key", key), "sizes")
        rows = d.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()  # one row per source
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        sizes = [(r.source, r.n) for r in rows]
        want = targets(sizes, share, passes)
        self.block = block or max(16, math.ceil(sum(want) / max_slots))
        self.sources = spark.createDataFrame(
            [(i, s, n, w, int(w), max(1, math.ceil(r.docs / BUCKET_DOCS))) for i, ((s, n), w, r) in enumerate(zip(sizes, want, rows))],
            "src int, source string, source_size long, target double, take long, parts long")
        quotas = [math.ceil(int(w) / self.block) for w in want]
        self.slots = schedule(spark, quotas, [max(w, 1e-9) for w in want] or [1.0], sum(quotas)) if quotas else None
        one = F.broadcast(self.sources.withColumnRenamed("source", "s"))  # one row per source
        placed = d.join(one.select("src", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        self.docs = (_shuffled(placed, self.sources.select("src", "parts"))
                     .join(F.broadcast(self.sources.drop("source", "parts")), "src"))

    def blocks(self) -> DataFrame:
        """(src, rank, doc_id, size, first, words): the stretches of documents in each block of the doubled stream."""
        b = F.lit(self.block)
        p = self.docs.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1))))
        p = p.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
        p = p.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).where("to > from")
        p = p.withColumn("rank", F.explode(F.expr(f"sequence(`from` div {self.block}, (`to` - 1) div {self.block})")))
        lo, hi = F.greatest("from", F.col("rank") * b), F.least("to", (F.col("rank") + 1) * b)
        return p.select("src", "rank", "doc_id", "key", "size", (lo - F.col("from")).alias("first"), (hi - lo).alias("words"))

    def plan(self) -> DataFrame:
        """(slot, src, doc_id, first, words): what every slot of the mix holds, joined block by block."""
        if self.slots is None:
            return self.blocks().select(F.col("rank").alias("slot"), "src", "doc_id", "key", "size", "first", "words")
        return self.blocks().join(self.slots, ["src", "rank"]).select("slot", "src", "doc_id", "key", "size", "first", "words")

    def readings(self) -> DataFrame:
        """(src, doc_id, size, slot, first, words): every read of a document, at the slot of the block in which it
        begins (the first of its slots in ``plan``) and ``first`` words into it; the read that meets the target ends
        there.  A document without words is read once where its place lies before the target."""
        p = self.docs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1)))).where("size > 0 or pass = 0")
        p = p.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).where("`from` < take")
        p = p.withColumn("rank", F.expr(f"`from` div {self.block}"))
        placed = p.withColumn("slot", F.col("rank")) if self.slots is None else p.join(self.slots, ["src", "rank"])
        return placed.select("src", "doc_id", "size", "slot", (F.col("from") % self.block).alias("first"),
                             F.least("size", F.col("take") - F.col("from")).alias("words"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null texts have size 0 and are never taken; a null source is a source of
    its own, last; null ids are ordinary; rows repeated exactly share what is
    taken of both; an empty table gives no rows.  Only doc_id, text and
    source are read.  The mix depends only on the rows and the seed.
    """
    m = Mix(docs, **kw)
    rows = m.docs.select("src", "doc_id", "size", "source_size", "target").groupBy("src", "doc_id", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("times"))
    got = m.plan().groupBy("src", "doc_id", "size").agg(F.sum("words").alias("words"))
    # (src, doc_id, size) names a row; exact repeats of a row share their words evenly, the first ones get the rest
    on = [rows["src"] == got["src"], rows["doc_id"].eqNullSafe(got["doc_id"]), rows["size"] == got["size"]]
    j = rows.join(got, on, "left").select(rows["doc_id"], rows["size"], "source_size", "target", "times", F.coalesce("words", F.lit(0)).alias("words"))
    each = j.withColumn("i", F.explode(F.expr("sequence(1L, times)")))
    taken = F.expr("words div times + if(i <= words % times, 1, 0)")
    return each.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` as often as the mix reads them, in the order of the slots at which it begins to.

    The read at which a source meets its target ends there: ``text`` then holds
    the words up to the target, so every source has its target's words, rounded
    down.  The other columns stay as they are.  Rows that share id, source and
    size are dealt their reads in turn.
    """
    m = Mix(docs, **kw)
    row = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"),
                      word_count(F.col("text")).alias("__size"), F.struct("*").alias("__row"))
    reads = m.readings().groupBy("src", "doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("slot", "first", "words"))).alias("reads"))
    times = m.docs.groupBy("src", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    on = [reads["src"] == times["src"], reads["doc_id"].eqNullSafe(times["doc_id"]), reads["size"] == times["size"]]
    names = F.broadcast(m.sources.select(F.col("src").alias("s"), F.col("source").alias("name")))  # one row per source
    dealt = (reads.join(times, on).select(reads["src"], reads["doc_id"].alias("__i"), reads["size"].alias("__z"), F.col("n").alias("__n"), F.col("reads").alias("__reads"))
             .join(names, F.col("src") == F.col("s")).select("__i", F.col("name").alias("__name"), "__z", "__n", "__reads"))
    on = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__name")) & (F.col("__size") == F.col("__z"))
    j = row.join(dealt, on)
    one = j.where("__n = 1").select("__row", "__size", "__reads")
    nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("__row.text"))) - 1
    turn = F.expr("filter(__reads, (x, i) -> i % __n = __nth)")
    many = j.where("__n > 1").withColumn("__nth", nth).select("__row", "__size", turn.alias("__reads"))
    out = one.unionByName(many).select("__row", "__size", F.explode("__reads").alias("__read"))
    upto = F.concat(F.lit(rf"^(?:{_SPACE}*+{WORD}+){{"), F.col("__read.words").cast("string"), F.lit("}+"))
    text = F.when(F.col("__read.words") < F.col("__size"), F.call_function("regexp_extract", F.col("__row.text"), upto, F.lit(0))).otherwise(F.col("__row.text"))
    out = out.repartitionByRange("__read.slot", "__read.first").sortWithinPartitions("__read.slot", "__read.first")
    return out.select(*[text.alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])
