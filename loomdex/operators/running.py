"""Running aggregates over one key of any size.

A plain window puts every row of a key in one task. Here a key is cut into
blocks along its order: block totals are a small table, its running total is
carried into each block, and each block is a window partition of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMBINE = {
    "sum": (F.sum, lambda carry, value: F.coalesce(carry, F.lit(0)) + F.coalesce(value, F.lit(0))),
    "max": (F.max, F.greatest),
}


def running(df: DataFrame, keys: list[str], block: Column, order: list, value: Column, how: str,
            name: str, include_row: bool = True) -> DataFrame:
    """Add ``name``: ``how`` ('sum' or 'max') of ``value`` over a key's rows so far.

    ``block`` must not decrease along ``order`` within a key. ``greatest``
    skips nulls, so the first row of a key without ``include_row`` gives null
    for 'max' and 0 for 'sum'.
    """
    aggregate, combine = COMBINE[how]
    rows = df.withColumn("_block", block).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_block").agg(aggregate("_value").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(*keys, "_block", aggregate("_total").over(before).alias("_carry"))
    frame = (
        W.partitionBy(*keys, "_block").orderBy(*order)
        .rowsBetween(W.unboundedPreceding, 0 if include_row else -1)
    )
    joined = rows.join(carries, [*keys, "_block"], "left")
    return joined.select(
        *df.columns, combine(F.col("_carry"), aggregate("_value").over(frame)).alias(name)
    )
