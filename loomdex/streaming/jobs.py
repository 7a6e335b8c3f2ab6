"""Streaming forms of the batch operators; stream and batch share the same code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.functions.constants import REQUESTS_PER_MINUTE
from loomdex.operators.logs import request_rate, signal_counts
from loomdex.plans.indexer import Indexer, newest_versions
from loomdex.plans.searcher import Searcher
from loomdex.session import materialize
from loomdex.sources.changes import file_versions, project_changes
from loomdex.sources.requests import number_lines


def _start(stream: DataFrame, work, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_files(versions: DataFrame, indexer: Indexer, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the index fresh from a stream of file versions ``path, content, mtime``.

    Null content deletes a file. A replayed batch finds its files unchanged
    and adds nothing. Small runs are put together on the way.
    """

    def work(batch, _):
        indexer.index_incremental(newest_versions(batch), complete=False)
        indexer.store.compact()

    return _start(versions, work, checkpoint, once)


def watch_project(root: str, indexer: Indexer, checkpoint: str, state: str, suffixes=None, once: bool = False) -> StreamingQuery:
    """Keep the index fresh from a folder; ``state`` is where the stream keeps its listings.

    Each batch holds what changed since the last one; only those files are read.
    """

    def work(batch, _):
        versions = materialize(file_versions(batch, root, suffixes), "versions")
        indexer.index_incremental(newest_versions(versions), complete=False)
        indexer.store.compact()

    return _start(project_changes(indexer.spark, root, state), work, checkpoint, once)


def answer_requests(lines: DataFrame, searcher: Searcher | Callable[[], Searcher], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answer a stream of request lines ``[line_no,] value`` into ``out/batch=N``.

    ``searcher`` may be a function that gives one, to see the newest index in
    each batch. A replayed batch overwrites its own folder.
    """

    def work(batch, number):
        if "line_no" not in batch.columns:
            batch = number_lines(batch)
        current = searcher if isinstance(searcher, Searcher) else searcher()
        current.replies(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(lines, work, checkpoint, once)


def request_rate_stream(log: DataFrame, late: str = "10 minutes", period: str = "1 minute", limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """Requests per key and period; rows later than ``late`` are dropped."""
    return request_rate(log.withWatermark("ts", late), period, limit)


def feedback_stream(feedback: DataFrame, late: str = "1 hour", period: str = "1 hour") -> DataFrame:
    """Feedback counts per window, query and chunk; add the windows up for totals."""
    windowed = feedback.withWatermark("ts", late).groupBy(F.window("ts", period), "query_id", "chunk_id")
    return windowed.agg(*signal_counts()).select(
        F.col("window.start").alias("window_start"), "query_id", "chunk_id", "positive", "negative", "total"
    )
