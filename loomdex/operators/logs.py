"""Operators over request and feedback logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions.constants import REQUESTS_PER_MINUTE


def request_rate(log: DataFrame, period: str = "1 minute", limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """``key, window_start, requests, over_limit`` of ``log(key, ts)``; batch or stream."""
    counted = log.groupBy(F.window("ts", period), "key").agg(F.count("*").alias("requests"))
    return counted.select(
        "key", F.col("window.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit")
    )


def admit(log: DataFrame, period: str = "1 minute", limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """``id, key, window_start, admitted``: the first ``limit`` requests of a key and period pass.

    Only the first ``limit`` rows of a group are ever ranked (cut before the
    shuffle); the last of them is the bar that all rows are compared with.
    """
    rows = log.withColumn("window_start", F.window("ts", period)["start"])
    group = ["key", "window_start"]
    ranks = F.row_number().over(W.partitionBy(*group).orderBy("ts", "id"))
    first = rows.select(*group, "ts", "id").withColumn("n", ranks).where(F.col("n") <= limit)
    bar = first.groupBy(*group).agg(F.max(F.struct("ts", "id")).alias("bar"))
    return rows.join(bar, group).select(
        "id", *group, (F.struct("ts", "id") <= F.col("bar")).alias("admitted")
    )


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """``query_id, chunk_id, positive, negative, total`` of ``signal`` rows."""
    return feedback.groupBy("query_id", "chunk_id").agg(*signal_counts())


def signal_counts():
    return (
        F.count(F.when(F.col("signal") > 0, 1)).alias("positive"),
        F.count(F.when(F.col("signal") < 0, 1)).alias("negative"),
        F.count("*").alias("total"),
    )
