"""One query per operator over its whole table, in the columns its contract names."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import (
    decontaminate, minhash, mixing, packing, pages, periodic, quality, ranked, secrets, substring, toxicity, urls, vectors)
from loomdex.llm.labelled import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.scored(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.evaluate(urls.captured(source), urls.drawn_entries(source))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.learn_and_scan(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select(
        "doc_id", "nth", F.length("value").alias("n_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "probability", "is_secret")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's periods: from some word on, a document in ten repeats a stretch of itself."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    index = np.arange(n)
    index[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return index


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), reorder=planted)
    found = found.withColumn("best", periodic.foremost(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_quality, op3_toxicity, op4_url_filter, op5_embedding_dedup, op6_minhash_dedup,
    op7_secret_scan, op8_substring_dedup, op9_decontamination, op10_source_mixing,
    op11_ranked_search, op12_packing, op13_periodic_runs)}
