"""One query per operator; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import fixtures as fx
from loomdex.functions import paths, text
from loomdex.functions.constants import CODE_MODEL, DEFAULT_IGNORE_RULES, EMBED_BATCH, SNIFF_BYTES
from loomdex.functions.vectors import hashed_vector
from loomdex.operators import (
    ann, chunking, dedup, embedding, knn, logs, packing, quantised, ranking, requests, tables)
from loomdex.plans.cells import CellIndex
from loomdex.plans.indexer import Indexer
from loomdex.plans.lexicon import LexicalIndex
from loomdex.plans.searcher import Searcher
from loomdex.session import materialize, scratch_dir
from loomdex.sources import project
from loomdex.streaming import admission, jobs

USER_RULES = ("*.json", "!src3/**/*.json", "/src4/de", "src[5-7]/*/*.tx?", "!build/")
CONTEXT_BUDGET = 1500
NEAR_EQUAL = 0.98


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


def wide_ranks(df: DataFrame) -> DataFrame:
    """Ranks as bigint, as the SQL side has them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in df.columns if c.endswith("rank")})


# --- scan, filter, route ---------------------------------------------------


def scan_suffix_filter(spark, sf):
    files = fx.doc_files(spark, sf)
    path = F.col("path")
    wanted = files.where(paths.has_suffix(path, [".py", ".js", ".go"]))
    return wanted.select(
        "path",
        paths.relative_path(path, "build").alias("rel_path"),
        paths.suffix(path).alias("suffix"),
        paths.file_name(path).alias("file_name"),
        chunking.language(path).alias("lang"),
    )


def ignore_rules(spark, sf):
    rules = [*USER_RULES, *DEFAULT_IGNORE_RULES]
    return fx.doc_files(spark, sf).select("path", paths.is_ignored(F.col("path"), rules).alias("ignored"))


def text_sniff(spark, sf):
    raw = fx.doc_files(spark, sf).select("path", F.col("content").cast("binary").alias("content"))
    kept = raw.where(text.is_text(F.col("content"), SNIFF_BYTES))
    decoded = text.decode_utf8(F.col("content"))
    return kept.select("path", F.md5(decoded).alias("text_md5"), F.length(decoded).cast("bigint").alias("chars"))


def bad_files(spark, sf):
    return chunking.parse_failures(fx.broken_py_sources(spark, sf)).select(
        "path", F.split("error", ":")[0].alias("error")
    )


def file_lookup(spark, sf):
    wanted = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("request_id"),
        F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/en/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"),
    )
    found = project.get_files(wanted, fx.doc_files(spark, sf), text.count_tokens)
    return found.select("request_id", "path", "status", "source", F.md5("content").alias("content_md5"), "tokens")


def file_route_code_text(spark, sf):
    model = chunking.model(F.col("path"))
    return fx.doc_files(spark, sf).select("path", model.alias("model"), chunking.space(model).alias("space"))


# --- chunks ----------------------------------------------------------------


def file_chunks_fallback(spark, sf):
    chunks = chunking.chunk_files(fx.doc_files(spark, sf).select("path", "content"))
    return chunks.select("path", "type", "kind", "name", "start_line", "end_line", F.md5("text").alias("text_md5"), "tokens")


def chunk_rows(chunks):
    return chunks.select("path", "lang", "space", "type", "kind", "name", "start_line", "end_line", "text")


def python_chunks(spark, sf):
    return chunk_rows(chunking.chunk_files(fx.py_sources(spark, sf)))


def brace_chunks(spark, sf):
    return chunk_rows(chunking.chunk_files(fx.brace_sources(spark, sf)))


def brace_depth(spark, sf):
    return chunking.brace_depth(materialize(fx.brace_sources(spark, sf), "sources")).select(
        "path", F.col("line_no").cast("bigint").alias("line_no"), "depth"
    )


def chunk_ids(spark, sf):
    return chunking.chunk_files(fx.py_sources(spark, sf)).select("path", "name", "chunk_id")


def outermost_chunks(spark, sf):
    chunks = chunking.chunk_files(fx.brace_sources(spark, sf)).drop("text")
    return chunking.outermost(materialize(chunks, "chunks")).select("path", "type", "name", "start_line", "end_line")


# --- index upkeep ----------------------------------------------------------


def changed_files(spark, sf):
    return tables.changed_files(fx.doc_files(spark, sf), fx.doc_state(spark, sf)).select("path", "mtime")


def file_state_upsert(spark, sf):
    files = fx.doc_files(spark, sf)
    old = fx.doc_state(spark, sf)
    new = tables.changed_files(files, old).select("path", "mtime")
    return tables.upsert(old, new, ["path"])


def index_replace_deleted(spark, sf):
    """Documents as the old index; labelled toxic ones are deleted, good ones re-indexed."""
    labels = fx.table(spark, sf, "labels")
    index = fx.doc_files(spark, sf).select("doc_id", "path", F.lit("old").alias("origin"))
    marked = index.join(labels, "doc_id", "left")
    fresh = marked.where("quality = 1").select("doc_id", "path", F.lit("new").alias("origin"))
    live = marked.where("coalesce(toxic, 0) = 0").select("path")
    return tables.replace_by_path(index, fresh, fresh.join(live, "path", "left_semi"), live).select("path", "origin")


def doc_chunks(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "source", "text", F.lit(CODE_MODEL).alias("model"))


def known_cache(spark, sf):
    """Cache left by a run over the labelled documents."""
    labelled = doc_chunks(spark, sf).join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return embedding.with_cache_key(labelled).groupBy("key").agg(F.max("doc_id").alias("version"))


def embed_cache_misses(spark, sf):
    misses = embedding.cache_misses(doc_chunks(spark, sf), known_cache(spark, sf))
    return misses.select("key", "model", F.length("text").cast("bigint").alias("chars"))


def embed_cache_upsert(spark, sf):
    new = embedding.with_cache_key(doc_chunks(spark, sf)).select("key", F.col("doc_id").alias("version"))
    return tables.upsert(known_cache(spark, sf), new, ["key"], ["version"])


def hashed_embedding(spark, sf):
    vectors = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(hashed_vector(F.col("text"))).alias("bucket", "n"))
    return vectors.where("n > 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n"))


def mean_pooling(spark, sf):
    pooled = embedding.mean_pool(fx.table(spark, sf, "embeddings"), "label")
    return rounded(
        pooled.select("label", F.posexplode("embedding").alias("pos", "mean")).withColumn("pos", F.col("pos").cast("bigint")), "mean"
    )


def batch_rows(spark, sf):
    return tables.fixed_batches(fx.table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", EMBED_BATCH)


def index_counts(spark, sf):
    return tables.index_counts(fx.vector_chunks(spark, sf).select("space", "path"))


def stale_versions(spark, sf):
    versions = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "2025-06-02").otherwise("2025-01-15").alias("index_version")
    )
    index = fx.bare_vectors(spark, sf).select("chunk_id", "space").join(versions, "chunk_id", "left")
    return tables.stale_rows(index, "2025-06-02").select("chunk_id", "space", "index_version")


def index_build(spark, sf):
    """A full run over the documents as files: the stored index."""
    files = fx.doc_files(spark, sf)
    kept = project.text_files(project.keep_wanted(
        files.select("path", F.col("content").cast("binary").alias("content"), F.col("mtime").cast("timestamp").alias("mtime")), F.col("path")
    ))
    indexer = Indexer(spark, scratch_dir(spark))
    indexer.index_full(kept)
    return indexer.store


def index_full(spark, sf):
    return rounded(index_build(spark, sf).vectors().select("chunk_id", "path", "space", "model", "end_line", "tokens", "norm"), "norm")


def run_metrics(spark, sf):
    """What a full and an incremental run report, as the store lists them."""
    first, second = file_drops(spark, sf)
    indexer = Indexer(spark, scratch_dir(spark))
    indexer.index_full(first)
    indexer.index_incremental(second, complete=False)
    commits = [tuple(c)[:5] for c in indexer.store.commits()]  # one small row a run
    return spark.createDataFrame(commits, "run int, full boolean, files bigint, deleted bigint, chunks bigint")


# --- search ----------------------------------------------------------------


def hit_rows(hits):
    return wide_ranks(rounded(hits, "distance"))


def knn_exact(spark, sf):
    hits = knn.nearest(fx.bare_vectors(spark, sf), fx.vector_queries(spark, sf), k=5, exclude_self=True)
    return hit_rows(hits.select("query_id", "chunk_id", "distance", "rank"))


def knn_filtered(spark, sf):
    where = {"$or": [{"kind": {"$in": ["class"]}}, {"label": {"$gte": 8}}], "space": {"$ne": "text"}}
    hits = knn.nearest(fx.bare_vectors(spark, sf), fx.vector_queries(spark, sf), k=10, where=where, exclude_self=True)
    return hit_rows(hits.select("query_id", "chunk_id", "distance", "rank"))


def knn_two_spaces(spark, sf):
    per_space = knn.nearest(fx.bare_vectors(spark, sf), fx.vector_queries(spark, sf), k=5, exclude_self=True, per_scope=True)
    merged = knn.ranked(per_space.withColumnRenamed("rank", "space_rank").withColumn("k", F.lit(5)), ["query_id"])
    return hit_rows(merged.select("query_id", "chunk_id", F.col("scope").alias("space"), "distance", "space_rank", "rank"))


CELLS, PROBES, REFINE = 16, 4, 400


def knn_ann(spark, sf):
    index = fx.bare_vectors(spark, sf)
    centres = materialize(ann.sampled_centres(index, CELLS), "centres")
    hits = ann.nearest_approximate(
        ann.with_cell(index, centres), fx.vector_queries(spark, sf), centres, k=5, probes=PROBES, exclude_self=True
    )
    return hit_rows(hits.select("query_id", "chunk_id", "distance", "rank"))


def knn_ann_trained(spark, sf):
    """Trained cells, all of them probed: the exact result."""
    index = fx.bare_vectors(spark, sf)
    centres = ann.trained_centres(index, CELLS)
    hits = ann.nearest_approximate(
        ann.with_cell(index, centres), fx.vector_queries(spark, sf), centres, k=5, probes=CELLS, exclude_self=True
    )
    return hit_rows(hits.select("query_id", "chunk_id", "distance", "rank"))


def knn_ann_after_update(spark, sf):
    """Cells built over old versions of the labelled documents, then brought up to an incremental run, never rebuilt.

    The run replaces what it knew, adds all other documents and deletes the toxic ones.
    """
    first, second = file_drops(spark, sf)
    indexer = Indexer(spark, scratch_dir(spark))
    indexer.index_full(first)
    cells = CellIndex.of(indexer.store, scratch_dir(spark), cells=CELLS)
    indexer.index_incremental(second, complete=False)
    searcher = Searcher.of(indexer.store, cells=cells.update(indexer.store), probes=CELLS, refine=REFINE)
    return hit_rows(searcher.hits(fx.text_queries(spark, sf), k=5).select("query_id", "chunk_id", "space", "distance", "rank"))


def recall_of(spark, index, queries, k, cells, probes, refine):
    """(queries, share of the k nearest that the search by codes finds): hits as near as the k-th nearest count."""
    centres = materialize(ann.trained_centres(index, cells), "centres")
    placed = materialize(ann.with_cell(index, centres), "placed")
    codec = quantised.Codec.of(centres, quantised.learned_books(placed, centres))
    coded = materialize(quantised.with_codes(placed, codec), "coded")
    held = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    found = quantised.nearest_by_code(coded, queries, codec, held, k, probes, refine).drop("distance", "rank")
    found = knn.ranked(quantised.exact_distances(found, coded, queries).withColumn("k", F.lit(k)), ["query_id"])
    last = knn.nearest(index, queries, k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("bar"))
    near = found.join(last, "query_id").where(F.col("distance") <= F.col("bar") + 1e-9)
    return near.groupBy("query_id").agg(F.count("*").alias("near"))


def knn_ann_recall(spark, sf):
    """Ten nearest documents by quantised codes, half of the cells probed: are nine in ten of the true ones found?"""
    index = fx.doc_vectors(spark, sf).drop("text")
    near = recall_of(spark, materialize(index, "vectors"), materialize(hashed_queries(spark, sf), "asked"), 10, CELLS, CELLS // 2, 10)
    return near.agg(F.count("*").alias("queries"), (F.avg("near") >= 9).alias("recall_reached"))


def knn_tiled(spark, sf):
    """All vectors as queries, dealt in tiles of queries and vectors as query sets past the broadcast bound are."""
    rows = knn.query_rows(fx.vector_queries(spark, sf), 5, 1)
    index = fx.bare_vectors(spark, sf).select("chunk_id", F.col("space").alias("scope"), "embedding")
    schema = "query_id bigint, chunk_id bigint, scope string, distance double, k int"
    found = knn.scan_in_tiles(index, rows, schema, lambda block: knn.BestSoFar(block, False))
    others = found.where("query_id <> chunk_id").withColumn("k", F.col("k") - 1)
    return hit_rows(knn.ranked(others, ["query_id"]).select("query_id", "chunk_id", "distance", "rank"))


def hashed_queries(spark, sf):
    return fx.text_queries(spark, sf).select("query_id", hashed_vector(text.normalise_query(F.col("text"))).alias("embedding"))


def rerank_lexical(spark, sf):
    docs = fx.doc_vectors(spark, sf)
    candidates = materialize(knn.nearest(docs, hashed_queries(spark, sf), k=20), "candidates")
    best = ranking.rerank(candidates.drop("scope"), docs, fx.text_queries(spark, sf), 5)
    return wide_ranks(rounded(best, "distance", "score")).select("query_id", "chunk_id", "distance", "first_rank", "score", "rank")


def updated_lexicon(spark, sf):
    """An index and its postings: built over old versions, then brought up to a run that replaces, adds and deletes."""
    first, second = file_drops(spark, sf)
    indexer = Indexer(spark, scratch_dir(spark))
    indexer.index_full(first)
    lexicon = LexicalIndex.of(indexer.store, scratch_dir(spark))
    indexer.index_incremental(second, complete=False)
    return indexer.store, lexicon.update(indexer.store)


def lexical_bm25(spark, sf):
    """Ten best chunks by words of every text query, over postings that followed an index run."""
    _, lexicon = updated_lexicon(spark, sf)
    return wide_ranks(lexicon.search(fx.text_queries(spark, sf), 10))


def hybrid_search(spark, sf):
    store, lexicon = updated_lexicon(spark, sf)
    return wide_ranks(Searcher.of(store).hybrid(fx.text_queries(spark, sf), lexicon, k=5, candidates=20))


def semantic_dedup(spark, sf):
    return dedup.near_duplicates(materialize(fx.doc_vectors(spark, sf).drop("text"), "vectors"), NEAR_EQUAL)


# --- context ---------------------------------------------------------------


def vector_packed(spark, sf, budget=CONTEXT_BUDGET):
    """Packed hits among all documents, for every text query."""
    index = fx.doc_index(spark, sf)
    hits = knn.nearest(index, hashed_queries(spark, sf), k=5)
    return packing.fetch_packed(hits.drop("scope"), index, budget)


def flat_contexts(answers):
    return answers.select(
        "query_id", F.md5("content").alias("content_md5"), F.length("content").cast("bigint").alias("chars"),
        F.size("metadata").cast("bigint").alias("hits"), "tokens",
    )


def context_for_query(spark, sf):
    return flat_contexts(packing.contexts(fx.text_queries(spark, sf), vector_packed(spark, sf)))


def search_results(spark, sf):
    rows = packing.results(vector_packed(spark, sf))
    return hit_rows(rows.withColumn("text_md5", F.md5("text")).drop("text"))


def stream_events(spark, sf):
    rows = packing.event_rows(fx.text_queries(spark, sf), vector_packed(spark, sf))
    data = F.from_json("data", "content string, metadata struct<path:string,start_line:int>, tokens bigint")
    return rows.withColumn("d", data).select(
        "query_id", "seq", "event", F.md5("d.content").alias("content_md5"), F.col("d.metadata.path").alias("path"), "d.tokens"
    )


def document_search(spark, sf):
    """Searcher over the documents as files, built from scratch."""
    return Searcher.of(index_build(spark, sf))


def context_for_text(spark, sf):
    """The whole way: files to chunks to vectors to hits to packed context."""
    return flat_contexts(document_search(spark, sf).context(fx.text_queries(spark, sf), max_tokens=CONTEXT_BUDGET))


# --- requests, logs --------------------------------------------------------


def query_normalise(spark, sf):
    return fx.text_queries(spark, sf).select("query_id", text.normalise_query(F.col("text")).alias("query"))


def request_validation(spark, sf):
    return requests.parse_requests(fx.request_lines(spark, sf)).select(
        "line_no", "type", F.md5("query").alias("query_md5"), "k", "max_tokens", "stream", "where", "message"
    )


def flat_replies(replies):
    shape = "status string, event string, message string, data struct<content:string,tokens:bigint>"
    return replies.withColumn("r", F.from_json("reply", shape)).select(
        "line_no", "seq", "r.status", "r.event", "r.message", F.md5("r.data.content").alias("content_md5"), "r.data.tokens"
    )


def request_replies(spark, sf):
    return flat_replies(document_search(spark, sf).replies(fx.request_lines(spark, sf)))


def request_stream(spark, sf):
    """The same requests as a stream of file drops."""
    drop, out, checkpoint = (scratch_dir(spark) for _ in range(3))
    lines = fx.request_lines(spark, sf)
    lines.repartition(2, "line_no").write.parquet(drop)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    jobs.answer_requests(stream, document_search(spark, sf), out, checkpoint, once=True).awaitTermination()
    return flat_replies(spark.read.parquet(out).drop("batch"))


def event_parse(spark, sf):
    """Conversation turns as event texts: users well-formed, others only in part."""
    turn = F.col("text")
    shaped = F.when(F.col("role") == "user", packing.event_text(F.lit("chunk"), F.to_json(F.struct("turn")))).when(
        F.col("role") == "assistant", F.concat(F.lit("event:end\n\ndata:"), F.regexp_replace(turn, "\\s+", " "))
    ).otherwise(F.concat(F.lit("event: note\n"), turn))
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", packing.parse_event_text(shaped).alias("e"))
    return rows.select("conv_id", "turn", "e.event", F.md5("e.data").alias("data_md5"))


def rate_limit_audit(spark, sf):
    return logs.request_rate(fx.request_log(spark, sf), "1 day", 5)


def rate_limit_admit(spark, sf):
    return logs.admit(fx.request_log(spark, sf), "1 day", 5)


def feedback_counts(spark, sf):
    return logs.feedback_counts(fx.feedback(spark, sf))


# --- streams ---------------------------------------------------------------


def run_stream(stream, out, checkpoint, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start(out).awaitTermination()


def streamed_events(spark, sf, columns, end_time, files_at_once=1000):
    """Events as file drops in no order, and one row far ahead that moves the watermark past them all."""
    drop = scratch_dir(spark)
    rows = columns(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(*[F.max(c).alias(c) for c in rows.columns]).withColumn("ts", F.lit(end_time).cast("timestamp"))
    (rows.repartition(4, F.xxhash64(rows.columns[0])) if files_at_once == 1 else rows).write.parquet(drop)
    last.coalesce(1).write.mode("append").parquet(drop)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_at_once).parquet(drop)


END_OF_TIME = "2100-01-01 00:00:00"


def closed_windows(spark, out):
    """What the stream wrote, without the window of the row that only moved the watermark."""
    windows = spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return windows.where("window_start < timestamp_ntz'2099-01-01'")


def rate_limit_stream(spark, sf):
    stream = streamed_events(spark, sf, fx.request_log, END_OF_TIME)
    out, checkpoint = scratch_dir(spark), scratch_dir(spark)
    run_stream(jobs.request_rate_stream(stream, period="1 day", limit=5), out, checkpoint)
    return closed_windows(spark, out)


def rate_limit_live(spark, sf):
    """Decisions taken while the requests stream in, out of order."""
    stream = streamed_events(spark, sf, fx.request_log, END_OF_TIME, files_at_once=1)
    out, checkpoint = scratch_dir(spark), scratch_dir(spark)
    run_stream(admission.admit_stream(stream, "40 days", period="1 day", limit=5), out, checkpoint)
    return closed_windows(spark, out)


def feedback_stream(spark, sf):
    stream = streamed_events(spark, sf, fx.feedback, END_OF_TIME)
    out, checkpoint = scratch_dir(spark), scratch_dir(spark)
    run_stream(jobs.feedback_stream(stream), out, checkpoint)
    return closed_windows(spark, out).groupBy("query_id", "chunk_id").agg(*[F.sum(c).alias(c) for c in ("positive", "negative", "total")])


def file_drops(spark, sf):
    """Files as two drops: first what the state knew, then every current version; toxic ones are deleted."""
    labels = fx.table(spark, sf, "labels")
    files = fx.doc_files(spark, sf).join(labels, "doc_id", "left").withColumn("mtime", F.col("mtime").cast("timestamp"))
    hour = F.make_dt_interval(hours=F.lit(1))
    first = files.where("quality is not null").select(
        "path", F.concat(F.lit("old "), "content").alias("content"), (F.col("mtime") - hour).alias("mtime")
    )
    second = files.select("path", F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("content")).alias("content"), "mtime")
    return first, second


def watch_incremental(spark, sf):
    drop, root, checkpoint = (scratch_dir(spark) for _ in range(3))
    indexer = Indexer(spark, root)
    for versions in file_drops(spark, sf):
        versions.write.mode("append").parquet(drop)
        stream = spark.readStream.schema(versions.schema).parquet(drop)
        jobs.watch_files(stream, indexer, checkpoint, once=True).awaitTermination()
    return indexer.store.chunks().select("path", "space", "end_line", F.md5("text").alias("text_md5"), "tokens", "mtime")


QUERIES = [
    scan_suffix_filter, ignore_rules, text_sniff, bad_files, file_lookup, file_route_code_text,
    file_chunks_fallback, python_chunks, brace_chunks, brace_depth, chunk_ids, outermost_chunks,
    changed_files, file_state_upsert, index_replace_deleted, embed_cache_misses, embed_cache_upsert,
    hashed_embedding, mean_pooling, batch_rows, index_counts, stale_versions, index_full, run_metrics,
    knn_exact, knn_filtered, knn_two_spaces, knn_ann, knn_ann_trained, knn_ann_after_update, knn_ann_recall, knn_tiled, rerank_lexical, lexical_bm25, hybrid_search, semantic_dedup,
    context_for_query, search_results, stream_events, context_for_text,
    query_normalise, request_validation, request_replies, event_parse,
    rate_limit_audit, rate_limit_admit, feedback_counts,
    request_stream, rate_limit_stream, rate_limit_live, feedback_stream, watch_incremental,
]
