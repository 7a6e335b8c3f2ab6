"""Request lines in, reply lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, unique and rising along each file."""
    return lines.select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of JSON-lines files."""
    return number_lines(spark.read.text(path))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of JSON-lines files as they arrive; lines are numbered per batch."""
    return spark.readStream.text(path)


def write_replies(replies: DataFrame, path: str) -> None:
    """One JSON reply per line, non-ASCII kept, in request and event order."""
    replies.repartitionByRange("line_no").sortWithinPartitions("line_no", "seq").select("reply").write.text(path)
