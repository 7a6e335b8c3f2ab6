"""Stored steps of long jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomdex.session import materialize, release


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and let go of the shuffles that made it.

    Spark deletes shuffle files once the driver's collector finds that nothing
    refers to them. A job that stores its steps one after the other asks for
    that here; otherwise the files of all steps lie on disk together. It asks
    before, too: just after a step its last events may still refer to it.
    """
    release(df.sparkSession)
    found = materialize(df, name)
    release(df.sparkSession)
    return found


def narrow(df: DataFrame, name: str) -> DataFrame:
    """Store a table of ids and numbers in at most two tasks a core of the cluster.

    Such a table is small beside the texts it stands for; iterative steps over it
    are then one or two waves of tasks however many shuffle partitions texts need.
    """
    return materialize(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), name)
