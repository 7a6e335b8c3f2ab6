"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Every query is run to the end through a sink that keeps
nothing; index runs include all their writes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import queries as catalogue
from loomdex.functions.vectors import hashed_vector
from loomdex.operators import ann, knn, packing, quantised
from loomdex.plans.indexer import Indexer
from loomdex.plans.lexicon import LexicalIndex
from loomdex.plans.searcher import Searcher
from loomdex.session import build_session, materialize, scratch_dir

HEADLINE = [
    "scan_suffix_filter", "ignore_rules", "text_sniff", "file_chunks_fallback", "python_chunks", "brace_chunks",
    "outermost_chunks", "changed_files", "embed_cache_misses", "embed_cache_upsert", "hashed_embedding",
    "mean_pooling", "batch_rows", "index_full", "knn_exact", "knn_filtered", "knn_two_spaces", "knn_ann",
    "knn_tiled", "rerank_lexical", "semantic_dedup", "context_for_query", "search_results", "stream_events",
    "context_for_text", "request_validation", "request_replies", "rate_limit_audit", "rate_limit_admit",
    "feedback_counts",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def rates(spark, sf) -> dict:
    """Throughput of index runs and batch search over the documents."""
    files = fx.doc_files(spark, sf).select("path", "content", F.col("mtime").cast("timestamp").alias("mtime"))
    files = materialize(files, "files")
    indexer = Indexer(spark, scratch_dir(spark))
    full = timed(lambda: indexer.index_full(files))
    chunks = indexer.store.vectors().count()
    late = F.col("mtime") + F.make_dt_interval(days=F.lit(400))
    edited = files.withColumns({
        "content": F.when(F.col("path").endswith(".json"), F.concat("content", F.lit(" edited"))).otherwise(F.col("content")),
        "mtime": F.when(F.col("path").endswith(".json"), late).otherwise(F.col("mtime")),
    })
    report = {}
    incremental = timed(lambda: report.update(indexer.index_incremental(edited)))
    searcher = Searcher.of(indexer.store)
    asked = materialize(fx.text_queries(spark, sf), "queries")
    n = asked.count()
    packed = timed(lambda: run(searcher.context(asked)))

    lexicon = LexicalIndex.of(indexer.store, scratch_dir(spark))
    by_words = timed(lambda: run(lexicon.search(asked, 10)))

    vectors = materialize(fx.vector_chunks(spark, sf), "vectors")
    queries = fx.vector_queries(spark, sf)
    m = queries.count()
    exact_time = timed(lambda: run(packing.contexts(queries, packing.pack(packing.fetch_chunks(knn.nearest(vectors, queries, 10, exclude_self=True).drop("scope"), vectors)))))
    single = sorted(timed(lambda i=i: searcher.context(f"how is part {i} made", k=5).collect()) for i in range(5))[2]
    kept = searcher.persist()
    single_kept = sorted(timed(lambda i=i: kept.context(f"how is part {i} made", k=5).collect()) for i in range(7))[3]
    kept.unpersist()

    # approximate against exact over passages of 50 words
    docs = fx.table(spark, sf, "documents").where("text is not null").repartition(64, "doc_id").withColumn("words", F.split("text", r"\s+"))
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(50)), lambda i: F.array_join(F.slice("words", i + 1, 50), " "))
    parts = docs.select("doc_id", F.posexplode(cut).alias("n", "text"))
    passages = materialize(parts.select(
        F.concat_ws("-", "doc_id", "n").alias("chunk_id"), F.lit("text").alias("space"), hashed_vector(F.col("text")).alias("embedding")), "passages")
    many = materialize(catalogue.hashed_queries(spark, sf), "many")
    centres = materialize(ann.trained_centres(passages, 64, sample=0.1), "centres")
    placed = materialize(ann.with_cell(passages, centres), "placed")
    codec = quantised.Codec.of(centres, quantised.learned_books(placed, centres))
    coded = materialize(quantised.with_codes(placed, codec), "coded")
    held = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def by_code():
        hits = materialize(quantised.nearest_by_code(coded, many, codec, held, 10, 12), "candidates").drop("distance", "rank")
        return knn.ranked(quantised.exact_distances(hits, coded, many).withColumn("k", F.lit(10)), ["query_id"])

    true = materialize(knn.nearest(passages, many, 10), "true")
    last = true.where("rank = 10").select("query_id", F.col("distance").alias("bar"))
    near = by_code().join(last, "query_id").where(F.col("distance") <= F.col("bar") + 1e-9).count()
    exact_passages = timed(lambda: run(knn.nearest(passages, many, 10)))
    coded_passages = timed(lambda: run(by_code()))
    return {
        "index_chunks_per_sec": round(chunks / full, 1),
        "incremental_share_reindexed": round(report["chunks"] / chunks, 3),
        "incremental_time_vs_full": round(incremental / full, 3),
        "text_context_queries_per_sec": round(n / packed, 1),
        "lexical_queries_per_sec": round(n / by_words, 1),
        "exact_knn_context_queries_per_sec": round(m / exact_time, 1),
        "single_query_ms": round(1000 * single),
        "single_query_persisted_ms": round(1000 * single_kept),
        "passages": passages.count(),
        "exact_passage_queries_per_sec": round(many.count() / exact_passages, 1),
        "approximate_passage_queries_per_sec": round(many.count() / coded_passages, 1),
        "approximate_recall_at_10": round(near / (10 * last.count()), 3),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="loomdex-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(catalogue.file_chunks_fallback(spark, sf))  # start JVM code paths and Python workers
    times = {}
    for name in HEADLINE:
        query = getattr(catalogue, name)
        times[name] = round(timed(lambda: run(query(spark, sf))), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "rates": rates(spark, sf),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
