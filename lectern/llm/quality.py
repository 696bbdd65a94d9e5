"""Quality rules: simple counts, and perplexity under a character n-gram model with language-specific bands.

The model is a modified Kneser-Ney one, estimated by Spark from the n-grams of
all texts: counts per n-gram, continuation counts for the lower orders,
three discounts per order, interpolation along the suffixes.  It is stored per
order as sorted 64-bit hashes with the costs of the n-gram and of
backing off from it, and looked up by binary search.

Texts are halved by a hash of the text, and each half is scored under the
model of the other one, so a text (and every exact copy of it) is judged by what the
rest of the corpus looks like, never by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import lots, saved, wide_hash
from lectern.session import ship_package

ORDER = 4
#: Costs are kept as whole millionths of a nat, so that sums do not depend on their order.
UNIT = 1_000_000
#: Entries of the model (16 bytes each) that are broadcast at a time.
MAX_SHIPPED = 4_000_000
#: A band reaches this many robust deviations below and above the language's median (sound texts with names, numbers
#: or a second language lie far above it, none far below), and is used from so many documents on.
BELOW, ABOVE, LEAST_DOCS = 5.0, 10.0, 30
#: Width of a bin of the median, in nats a character.
BIN = 0.001
#: Variance of the cost of one character that does not average out, in squared nats a character.
SPREAD = 6.0

START, END = "\x02", "\x03"
SYMBOLS = b"#*$%&|<>"
NONE = -1  # cost of a context that never ends a text's n-gram
_KEEP = 1_000_000  # n-grams a task holds before it emits them


# -- counts of one text -----------------------------------------------------

def _factor(x: np.ndarray) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(x, return_inverse=True)
    return inverse.astype(np.int64), len(values)


def repeated_words(texts: list[list[bytes]], width: int = 5) -> np.ndarray:
    """Per text, the words inside windows of ``width`` words that occur twice or more in it.

    Windows are compared exactly: words become numbers, then pairs of numbers, each step re-numbered.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    if not len(sizes) or sizes.max() <= width:
        return out
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    key, n = words, len(known)
    for k in range(1, width):
        key, _ = _factor(key[:len(words) - k] * n + words[k:])
    at = np.flatnonzero(owner[:len(key)] == owner[width - 1:])
    same, n = _factor(key[at] * len(texts) + owner[at])
    again = at[np.bincount(same, minlength=n)[same] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return np.bincount(owner, np.cumsum(cover)[:-1] > 0, len(texts)).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def sound(raw: bytes, words: list[bytes]) -> bool:
    """Whether a text teaches the model: at most one symbol in ten words."""
    return 10 * symbols(raw) <= len(words)


# -- n-grams ----------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as columns of code points."""
    acc = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
    return _mix(acc)


def _columns(grams: list[str], k: int) -> list[np.ndarray]:
    m = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), k)
    return [m[:, i] for i in range(k)]


def plain(words: list[bytes], order: int) -> str:
    """The text that the model sees: words joined by one blank between start and end marks."""
    return START * (order - 1) + b" ".join(words).decode("utf-8", "surrogatepass") + END


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, last places of the n-grams, text of each n-gram) of prepared texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = np.flatnonzero(np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[owner] >= order - 1)
    return codes, last, owner[last]


def _count(order: int):
    """(lang, half, gram, n) of the texts of a partition."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def compact(key: tuple) -> None:
            grams, n = (np.concatenate(x) for x in zip(*held[key]))
            _, at, inv = np.unique(_hash(list(grams.T)), return_index=True, return_inverse=True)
            held[key] = [(grams[at], np.bincount(inv, n).astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            for key in held:
                compact(key)
                grams, n = held[key][0]
                whole = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                out = [pa.array([key[0]] * len(n), pa.string()), pa.array(np.full(len(n), key[1], np.int32)),
                       pa.array([whole[i:i + order] for i in range(0, len(whole), order)], pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(out, ["lang", "half", "gram", "n"])
            held.clear()
        for batch in batches:
            for sub in lots(batch, 2, 1 << 14, 1 << 21):
                langs, halves, texts = (sub.column(i).to_pylist() for i in range(3))
                groups: dict[tuple, list] = {}
                for lang, half, t in zip(langs, halves, texts):
                    raw = t.encode("utf-8", "surrogatepass")
                    words = raw.split()
                    if sound(raw, words):
                        groups.setdefault((lang, half), []).append(plain(words, order))
                for key, own in groups.items():
                    codes, last, _ = _codes(own, order)
                    h, at, n = np.unique(_hash([codes[last - order + 1 + i] for i in range(order)]), return_index=True, return_counts=True)
                    held.setdefault(key, []).append((np.stack([codes[last[at] - order + 1 + i] for i in range(order)], axis=1), n))
                    if len(held[key]) >= 8:
                        compact(key)
            if sum(len(n) for x in held.values() for _, n in x) > _KEEP:
                yield from flush()
        yield from flush()
    return count


# -- the model --------------------------------------------------------------

def _parts(docs: DataFrame) -> DataFrame:
    """(lang, half, text) of the texts: a null language is one of its own, named ''."""
    return docs.where(F.col("text").isNotNull()).select(language(F.col("lang")).alias("lang"), half(F.col("text")).alias("half"), F.col("text"))


def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def _cost(p: Column) -> Column:
    return F.round(F.lit(-float(UNIT)) * F.log(p)).cast("int")


def estimate(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, half, k, gram, cost, back): the model of every language and half over all sound texts of (text, lang).

    ``cost`` is the cost of the n-gram's last character behind the others (NONE for a mere context), ``back`` that of
    backing off from it.  The row with k = 0 holds the cost of a character never seen.
    Counts are taken in place and added up by n-gram; nothing of the corpus reaches the driver.
    """
    ship_package(docs.sparkSession)
    model = ["lang", "half"]
    counts = {order: saved(_parts(docs).mapInArrow(_count(order), "lang string, half int, gram string, n long")
                           .groupBy(*model, "gram").agg(F.sum("n").alias("c")), "grams")}
    for k in range(order - 1, 0, -1):  # the lower orders count the different characters in front
        counts[k] = saved(counts[k + 1].groupBy(*model, F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams")
    below, out = None, None
    for k in range(1, order + 1):
        g = counts[k].withColumn("ctx", F.substring("gram", 1, k - 1))
        tally = counts[k].groupBy(*model).agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)],
                                              F.count(F.lit(1)).alias("kinds"))  # one row per language and half
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
        known = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0) & (F.col("t4") > 0)
        for i in (1, 2, 3):
            d = i - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}"))
            tally = tally.withColumn(f"d{i}", F.when(known & (d > 0) & (d < i), d).otherwise(F.lit(i / 2)))
        w = Window.partitionBy(*model, "ctx")  # at most one row per character
        g = (g.join(tally, model)
             .withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
             .withColumn("all", F.sum("c").over(w)).withColumn("free", F.sum("d").over(w) / F.col("all")))
        own = (F.col("c") - F.col("d")) / F.col("all")
        if k == 1:
            g = g.withColumn("p", own + F.col("free") / (F.col("kinds") + 1)).withColumn("unseen", F.col("free") / (F.col("kinds") + 1))
        else:
            lower = below.select(*model, F.col("gram").alias("suffix"), F.col("p").alias("q"))
            g = g.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, [*model, "suffix"]).withColumn("p", own + F.col("free") * F.col("q"))
        extra = ["unseen"] if k == 1 else []
        level = saved(g.select(*model, "gram", "ctx", "p", "free", *extra), "level")
        rows = level.select(*model, F.lit(k).alias("k"), "gram", _cost(F.col("p")).alias("cost"))
        backs = level.groupBy(*model, "ctx").agg(F.first("free").alias("free"), *[F.first(c).alias(c) for c in extra])
        if k == 1:
            out = backs.select(*model, F.lit(0).alias("k"), F.lit("").alias("gram"), _cost(F.col("unseen")).alias("cost"), F.lit(0).alias("back"))
        else:
            # the start marks are a context that is no n-gram: its cost is NONE
            both = held.join(backs.select(*model, F.col("ctx").alias("gram"), _cost(F.col("free")).alias("back")), [*model, "gram"], "full")
            out = out.unionByName(both.withColumn("k", F.lit(k - 1)).withColumn("cost", F.coalesce("cost", F.lit(NONE))))
        held, below = rows, level
    return saved(out.unionByName(held.withColumn("back", F.lit(None).cast("int"))).withColumn("back", F.coalesce("back", F.lit(0))), "model")


class Arrays:
    """The model of one language and half: per order, sorted hashes with costs and back-off costs."""

    def __init__(self, unseen: int, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.unseen, self.orders = unseen, orders

    @classmethod
    def build(cls, k: np.ndarray, gram: list[str], cost: np.ndarray, back: np.ndarray, order: int) -> Arrays:
        orders = []
        for n in range(1, order + 1):
            own = np.flatnonzero(k == n)
            h = _hash(_columns([gram[i] for i in own], n)) if len(own) else np.zeros(0, np.uint64)
            by = np.argsort(h)
            orders.append((h[by], cost[own][by], back[own][by]))
        return cls(int(cost[k == 0][0]), orders)

    def _find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.orders[n - 1][0]
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)

    def costs(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Cost of the characters at ``last``, each behind the characters before it."""
        order = len(self.orders)
        out, todo = np.zeros(len(last), np.int64), np.arange(len(last))
        for n in range(order, 0, -1):
            place = last[todo]
            at, hit = self._find(n, _hash([codes[place - n + 1 + i] for i in range(n)]))
            if len(self.orders[n - 1][0]):
                hit &= self.orders[n - 1][1][at] != NONE
            out[todo[hit]] += self.orders[n - 1][1][at[hit]]
            todo, place = todo[~hit], place[~hit]
            if not len(todo):
                return out
            if n > 1:
                at, hit = self._find(n - 1, _hash([codes[place - n + 1 + i] for i in range(n - 1)]))
                out[todo[hit]] += self.orders[n - 2][2][at[hit]]
        out[todo] += self.unseen
        return out


def shipped(model: DataFrame, order: int = ORDER) -> dict[tuple[str, int], Arrays]:
    """The arrays of every language and half; call it on a model of counted size."""
    t = model.select("lang", "half", "k", "gram", "cost", "back").toArrow()
    out = {}
    for key in t.group_by(["lang", "half"]).aggregate([]).to_pylist():
        own = t.filter((pc.field("lang") == key["lang"]) & (pc.field("half") == key["half"]))
        k, cost, back = (own.column(c).to_numpy() for c in ("k", "cost", "back"))
        out[key["lang"], key["half"]] = Arrays.build(k, own.column("gram").to_pylist(), cost, back, order)
    return out


def _lots(model: DataFrame, most: int) -> tuple[list[list[str]], list[str]]:
    """(lots of languages of at most ``most`` entries each, languages that have more alone)."""
    sizes = sorted((r.lang, r.n) for r in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per language
    lots, room, large = [[]], most, []
    for lang, n in sizes:
        if n > most:
            large.append(lang)
            continue
        if n > room:
            lots.append([])
            room = most
        lots[-1].append(lang)
        room -= n
    return lots, large


# -- scores -----------------------------------------------------------------

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, cost long, n_grams long"


def _measure(texts: list[str], langs: list[str], halves: list[int], arrays: dict | None, order: int) -> np.ndarray:
    """The columns of _STATS; cost and n_grams stay 0 without a model of the other half."""
    out = np.zeros((7, len(texts)), np.int64)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [b.split() for b in raw]
    seen = [plain(w, order) for w in words]
    out[0] = [len(w) for w in words]
    out[1] = [len(s) - order - max(0, len(w) - 1) for s, w in zip(seen, words)]
    out[2] = [symbols(b) for b in raw]
    out[3] = [repeated_lines(t) for t in texts]
    out[4] = repeated_words(words)
    groups: dict[tuple, list[int]] = {}
    for i, (lang, h) in enumerate(zip(langs, halves)):
        if words[i] and arrays and (lang, 1 - h) in arrays:
            groups.setdefault((lang, 1 - h), []).append(i)
    for key, at in groups.items():
        codes, last, owner = _codes([seen[i] for i in at], order)
        out[5, at] = np.bincount(owner, arrays[key].costs(codes, last), len(at)).astype(np.int64)  # exact: far below 2**53
        out[6, at] = np.bincount(owner, minlength=len(at))
    return out


_NAMES = [c.split()[0] for c in _STATS.split(", ")]
_STRUCT = "struct<" + _STATS.replace(" long", ":long") + ">"


def score_documents(docs: DataFrame, order: int = ORDER, max_shipped: int = MAX_SHIPPED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, default all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cost
    and n_grams (columns of these names are replaced): cost is that of the text under the model of the other half, over n_grams characters.

    Null texts are empty.  Empty and wordless texts, and texts whose language
    has no text in the other half, have no cost (0 over 0 characters).  Long texts are
    read whole; repeated rows are rows of their own; an empty table stays empty.

    The model is counted by language first.  Up to ``max_shipped`` entries it is
    broadcast as arrays and texts are scored in place.  A larger one is
    shipped in lots of languages, one pass over their documents each, written before
    the next lot is sent; a language that is too large alone joins its texts' n-grams with the model.
    """
    model = estimate(docs, order)
    lots_, large = _lots(model, max_shipped)
    keep = [c for c in keep or docs.columns if c not in _NAMES]
    lang, parts = language(F.col("lang")), []
    elsewhere = [x for lot in lots_[1:] for x in lot] + large
    for i, lot in enumerate(lots_):
        own = docs if not elsewhere else docs.where(lang.isin(lot)) if i else docs.where(~lang.isin(elsewhere))
        shared = docs.sparkSession.sparkContext.broadcast(shipped(model.where(F.col("lang").isin(lot)), order))  # at most max_shipped entries
        part = _in_place(own, shared, keep, order)
        if elsewhere:
            part = saved(part, "scored")
            shared.unpersist()
        parts.append(part)
    if large:
        parts.append(_joined(docs.where(lang.isin(large)), model.where(F.col("lang").isin(large)), keep, order))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _in_place(docs: DataFrame, shared, keep: list[str], order: int) -> DataFrame:
    """Counts and costs of every row under the broadcast arrays (None: counts alone)."""
    @F.pandas_udf(_STRUCT)
    def measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        arrays = shared.value if shared is not None else None
        for text, lang, h in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(lang, pa.string()), pa.array(h, pa.int32())], ["t", "l", "h"])
            got = [_measure(*(sub.column(i).to_pylist() for i in range(3)), arrays, order) for sub in lots(batch, 0, 1 << 14, 1 << 21)]
            yield pd.DataFrame(dict(zip(_NAMES, np.concatenate(got, axis=1) if got else np.zeros((7, 0), np.int64))))
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = [F.col(f"`{c}`") for c in keep]
    out = docs.select(*cols, measure(text, language(F.col("lang")), half(text)).alias("__q"))
    return out.select(*cols, *[F.col(f"__q.{c}") for c in _NAMES])


def _joined(docs: DataFrame, model: DataFrame, keep: list[str], order: int) -> DataFrame:
    """Counts in place, and costs from a join of the texts' n-grams with the model, for a language too large to ship."""
    key = [h.alias(f"__h{i}") for i, h in enumerate(wide_hash(language(F.col("lang")), F.coalesce(F.col("text"), F.lit(""))))]
    texts = docs.where(F.col("text").isNotNull()).select(*key, language(F.col("lang")).alias("lang"), half(F.col("text")).alias("half"), "text").dropDuplicates(["__h0", "__h1"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in lots(batch, 4, 256, 1 << 20):
                seen = [plain(t.encode("utf-8", "surrogatepass").split(), order) for t in sub.column(4).to_pylist()]
                rows = [(i, s[j:j + order]) for i, s in enumerate(seen) if len(s) > order for j in range(len(s) - order + 1)]
                if rows:
                    t = pa.table({"i": [r[0] for r in rows], "gram": [r[1] for r in rows]}).group_by(["i", "gram"]).aggregate([([], "count_all")])
                    at = t.column("i").combine_chunks()
                    cols = [sub.column(c).take(at) for c in range(3)] + [pa.array(1 - sub.column(3).take(at).to_numpy(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cols, t.column("gram").combine_chunks(), t.column("count_all").combine_chunks()],
                                                     ["__h0", "__h1", "lang", "half", "gram", "n"])
    grams = saved(texts.mapInArrow(split, "__h0 long, __h1 long, lang string, half int, gram string, n long"), "textgrams")
    by = ["lang", "half"]
    unseen = model.where("k = 0").select(*by, F.col("cost").alias("unseen"))
    todo = grams.select(*by, "gram").distinct().join(unseen, by).withColumn("at", F.col("gram")).withColumn("sum", F.lit(0))
    done = None
    for k in range(order, 0, -1):
        entry = model.where((F.col("k") == k) & (F.col("cost") != NONE)).select(*by, F.col("gram").alias("at"), "cost")
        j = saved(todo.join(entry, [*by, "at"], "left"), "lookup")
        hit = j.where("cost is not null").select(*by, "gram", (F.col("sum") + F.col("cost")).alias("price"))
        done = hit if done is None else done.unionByName(hit)
        backs = model.where(F.col("k") == k - 1).select(*by, F.col("gram").alias("ctx"), "back")
        miss = j.where("cost is null").drop("cost").withColumn("ctx", F.substring("at", 1, k - 1))
        todo = (miss.join(backs, [*by, "ctx"], "left").withColumn("sum", F.col("sum") + F.coalesce("back", F.lit(0)))
                .withColumn("at", F.substring("at", 2, k)).drop("ctx", "back"))
    done = done.unionByName(todo.select(*by, "gram", (F.col("sum") + F.col("unseen")).alias("price")))
    sums = (grams.join(done, [*by, "gram"]).groupBy("__h0", "__h1")
            .agg(F.sum(F.col("n") * F.col("price")).cast("long").alias("__cost"), F.sum("n").alias("__n")))
    # the counts and the costs of a row meet by the hash of its text
    own = _in_place(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), "text", "lang", *key), None, ["__row", "__h0", "__h1"], order)
    j = own.drop("cost", "n_grams").join(sums, ["__h0", "__h1"], "left")
    return j.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], *_NAMES[:5],
                    F.coalesce("__cost", F.lit(0)).alias("cost"), F.coalesce("__n", F.lit(0)).alias("n_grams"))


# -- verdicts ---------------------------------------------------------------

def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def per_char() -> Column:
    return F.try_divide(F.col("cost") / F.lit(float(UNIT)), F.col("n_grams"))


def _median(rows: DataFrame, value: Column) -> DataFrame:
    """(lang, m, n): the lower median of ``value`` in bins of BIN, exactly and without holding a language's rows: a
    language's bins, written first, are at most the thousandths of a nat that its texts' costs take."""
    bins = saved(rows.select("lang", F.floor(value / F.lit(BIN)).alias("b")).groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n")), "bins")
    w = Window.partitionBy("lang")
    c = bins.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    return c.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg((F.min("b") * F.lit(BIN)).alias("m"), F.first("all").alias("n"))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, middle, spread): median cost a character of each language's sound documents, and their robust deviation.

    Documents that fail the simple counts or have no cost are left out; so is a
    language with fewer than LEAST_DOCS of the others.
    """
    d = scored.where(~base_failed() & (F.col("n_grams") > 0)).select(language(F.col("lang")).alias("lang"), per_char().alias("x"))
    mid = _median(d, F.col("x")).where(F.col("n") >= LEAST_DOCS).select("lang", F.col("m").alias("middle"))
    off = _median(d.join(mid, "lang").select("lang", F.abs(F.col("x") - F.col("middle")).alias("x")), F.col("x"))
    return mid.join(off.select("lang", (1.4826 * (F.col("m") + F.lit(BIN))).alias("spread")), "lang")


def judge(scored: DataFrame, by: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """``scored`` with perplexity, low, high, base_failed and kept (columns of these names are replaced).

    A document is rejected by the method where its perplexity lies outside [low, high]:
    exp(middle - below * d) to exp(middle + above * d) with d = sqrt(spread**2 + SPREAD / n_grams), so a short
    text, whose mean varies more, has a wider band.  Without a cost or a band (null in low and high) the method keeps it.
    """
    own = ("perplexity", "low", "high", "base_failed", "kept")
    j = scored.drop(*own).withColumn("__lang", language(F.col("lang"))).join(by.withColumnRenamed("lang", "__lang"), "__lang", "left")
    x = F.when(F.col("n_grams") > 0, per_char())
    reach = F.sqrt(F.col("spread") * F.col("spread") + F.try_divide(F.lit(SPREAD), F.col("n_grams")))
    within = F.coalesce((x >= F.col("middle") - below * reach) & (x <= F.col("middle") + above * reach), F.lit(True))
    return (j.withColumn("perplexity", F.exp(x)).withColumn("low", F.exp(F.col("middle") - below * reach)).withColumn("high", F.exp(F.col("middle") + above * reach))
            .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within).drop("__lang", "middle", "spread"))


def filter_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The documents that the rules keep, with whole texts and all their columns."""
    scored = saved(score_documents(docs.select(F.struct("*").alias("__row"), "text", "lang"), order), "quality")
    return judge(scored, saved(bands(scored), "bands")).where("kept").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
