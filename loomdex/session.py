"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="loomdex", master=None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),  # long files make heavy rows
        "spark.sql.parquet.pushdown.inFilterThreshold": "500",  # ids of hits reach the Bloom filters
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint directory.

    ``spark.checkpoint.dir`` names a folder every executor can reach. Only a
    local session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="loomdex-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loomdex-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to: Spark deletes them once the driver's collector finds that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage at a table that survives the loss of executors, and keeps
    column pruning and filter pushdown for its readers.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
