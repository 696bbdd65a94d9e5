"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import lots
from lectern.session import ship_package

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents read per language when fitting (chosen by a hash of the id; whole texts).
TRAIN_DOCS_PER_LANG = 4000
#: Characters counted or scored at a time; their arrays take about 80 bytes a character.
SLICE = 1 << 17
#: Rows, and bytes of text, that Python holds as strings at a time (one row at least).
LOT_ROWS, LOT_BYTES = 4096, 1 << 20


def _lowered(text: str) -> str:
    return text.replace("\0", " ").lower()


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets[order, position], start of each text) of the lower-cased texts, ends marked by a
    separator; n-grams that touch a separator fall into the extra bucket BUCKETS."""
    return _buckets("\0".join(map(_lowered, texts)) + "\0")


def _buckets(joined: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(c == 0)[:-1] + 1])
    out = np.full((len(ORDERS), len(c)), BUCKETS, np.int32)
    acc, clean = np.zeros(len(c), np.uint64), np.ones(len(c), bool)
    for k in range(1, max(ORDERS) + 1):
        n = len(c) - k + 1
        if n <= 0:
            break
        acc = acc[:n] * np.uint64(0x9E3779B97F4A7C15) + c[k - 1:] + np.uint64(1)
        clean = clean[:n] & (c[k - 1:] != 0)
        if k in ORDERS:
            h = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[ORDERS.index(k), :n][clean] = (h >> np.uint64(48)).astype(np.int32)[clean]
    return out, starts


def _slices(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, buckets, starts) of about SLICE characters at a time.  A longer text comes in several
    parts; each n-gram belongs to the part it starts in, so all are there once."""
    rows, held = [], 0
    for i, t in enumerate(texts):
        if len(t) > SLICE:
            low = _lowered(t)
            for at in range(0, len(low), SLICE):
                buckets, _ = _buckets(low[at:at + SLICE + max(ORDERS) - 1] + "\0")
                yield [i], buckets[:, :SLICE], np.zeros(1, np.int64)
            continue
        if rows and held + len(t) >= SLICE:
            yield rows, *gram_buckets([texts[j] for j in rows])
            rows, held = [], 0
        rows.append(i)
        held += len(t) + 1
    if rows:
        yield rows, *gram_buckets([texts[j] for j in rows])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language of a partition: at most BUCKETS rows a language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lot in lots(batch, 1, LOT_ROWS, LOT_BYTES):
            langs, texts = lot.column(0).to_pylist(), lot.column(1).to_pylist()
            for lang in set(langs):
                for _, buckets, _ in _slices([t for t, x in zip(texts, langs) if x == lang]):
                    got = np.bincount(buckets.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                    counts[lang] = counts.get(lang, 0) + got
    for lang, got in counts.items():
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))],
                                         ["lang", "bucket", "n"])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class LanguageModel:
    """Log-probabilities of each bucket under each language (Laplace smoothing), and log priors."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior

    @classmethod
    def fit(cls, labelled: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> LanguageModel:
        """Learn from (doc_id, lang, text); rows without lang or text are passed over.

        At most about ``per_lang`` documents a language are read, those with
        the lowest hash of their id; what reaches the driver is one row per
        (language, bucket) seen, at most 65,536 a language.
        """
        ship_package(labelled.sparkSession)
        d = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
        totals = {r.lang: r.n for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        langs = sorted(totals)
        if not langs:
            return cls([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
        share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / totals[k]))]), F.col("lang"))
        picked = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
        rows = (picked.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
                .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
        counts = np.ones((BUCKETS + 1, len(langs)))
        at = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], dtype=int)
        counts[rows.column("bucket").to_numpy(), at] += rows.column("n").to_numpy()
        logp = np.log(counts / counts[:BUCKETS].sum(axis=0))
        logp[BUCKETS] = 0.0
        docs = np.array([totals[x] for x in langs], float)
        return cls(langs, logp.astype(np.float32), np.log(docs / docs.sum()))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of texts that hold a letter; the score is the winner's posterior,
        with the evidence of a long text counted as that of 50 n-grams."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, grams = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for rows, buckets, starts in _slices(texts):
            for order in buckets:
                total[rows] += np.add.reduceat(self.logp[order], starts, axis=0, dtype=np.float64)
                grams[rows] += np.add.reduceat(order < BUCKETS, starts, dtype=np.int64)
        total += self.prior
        z = total * np.minimum(1.0, 50.0 / np.maximum(grams, 1))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return [self.langs[i] for i in total.argmax(axis=1)], (z / z.sum(axis=1, keepdims=True)).max(axis=1)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced).

    Prediction reads the text alone: `und` with score 0 where it is null or
    has no letter (so also where it is empty), else a learned language; ties
    go to the first language in order.  Every row and column stays; long texts
    are read whole; an empty table gives an empty table.  No shuffle: the model
    (65,537 floats a language) is broadcast and texts are scored in place; of
    Spark's batch, Python holds a lot of texts as strings.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.prior))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = LanguageModel(*shared.value)
        for batch in batches:
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            at = 0
            for lot in lots(pa.RecordBatch.from_arrays([batch], ["text"]), 0, LOT_ROWS, LOT_BYTES):
                text = lot.column(0)
                own = at + np.flatnonzero(pc.is_valid(text).to_numpy(zero_copy_only=False))
                if len(own):
                    lang[own], score[own] = m.predict(text.drop_null().to_pylist())
                at += len(text)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])
    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], predict(text).alias("__pred"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__pred.lang_pred").alias("lang_pred"), F.col("__pred.score").alias("score"))
