"""The queries opN_<name> over the driver tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (fingerprints, language, licences, linededup, minhash, mixing, negatives, packing, pii,
                         quality, resample, tokenfile, vectors)
from lectern.llm.common import saved, scratch_path
from lectern.llm.oracles import SQL
from lectern.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn
    return keep


def crc32(ids: str) -> Column:
    """Unsigned crc32 of little-endian uint32 ids."""
    return F.crc32(F.col(ids)).alias("ids_crc32")


@query("op1_pack")
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(read_table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", crc32("ids"), "doc_tokens", "sequence_id", "offset")


@query("op2_licences")
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.LicenceModel.fit(docs))


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(read_table(spark, sf_dir, "documents"))


@query("op4_token_file")
def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = scratch_path(docs, "tokens")
    tokenfile.write_token_file(docs, path)
    return tokenfile.read_token_file(spark, path).select("doc_id", "start", "n_tokens", crc32("ids"))


@query("op5_near_vectors")
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))


@query("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def printed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return d.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(printed(base), 256).alias("base_sha256"), printed(F.col("pii")).alias("spans"),
                    F.coalesce(F.round(F.array_max(F.transform("pii", lambda s: s["score"])), 2), F.lit(0.0)).alias("top_score"))


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.LanguageModel.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return (language.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op10_mix")
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


@query("op11_resample")
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.draw(resample.score_documents(docs, read_table(spark, sf_dir, "benchmark")))


@query("op12_negatives")
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings").where(negatives.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = v.select("vec_id", label.alias("label"), negatives.scaled(F.col("embedding")).alias("embedding"))
    return negatives.mine_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = saved(quality.score_documents(docs, keep=["doc_id", "lang"]), "quality")
    return quality.judge(scored, saved(quality.bands(scored), "bands")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "low", "high")


ORACLE = {name: SQL[name] for name in QUERIES if name in SQL}
