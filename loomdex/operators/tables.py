"""Keyed tables: latest-wins upsert, change detection, replace by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators.running import running

ROWS_PER_BLOCK = 1 << 20


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``version`` columns.

    ``max_by`` combines on the map side, so a key with very many versions is
    reduced before the shuffle.
    """
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*version)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in or over it.

    Without ``version`` every new row beats the old row of its key.
    """
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(tagged, keys, [*(version or []), "_new"]).drop("_new")


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files without a known mtime or with a newer one."""
    known = state.select("path", F.col("mtime").alias("_known"))
    return (
        files.join(known, "path", "left")
        .where(F.col("_known").isNull() | (F.col("mtime") > F.col("_known")))
        .drop("_known")
    )


def deleted_paths(state: DataFrame, files: DataFrame) -> DataFrame:
    return state.select("path").join(files.select("path"), "path", "left_anti")


def replace_by_path(index: DataFrame, replaced: DataFrame, fresh: DataFrame, live: DataFrame) -> DataFrame:
    """Drop rows of replaced and of no longer live paths, then add ``fresh``."""
    kept = index.join(replaced.select("path"), "path", "left_anti").join(
        live.select("path"), "path", "left_semi"
    )
    return kept.select(*index.columns).unionByName(fresh.select(*index.columns))


def stale_rows(index: DataFrame, current_version: str) -> DataFrame:
    """Rows embedded under an older index version: the set to embed again."""
    return index.where(F.coalesce(F.col("index_version"), F.lit("")) < current_version)


def index_counts(index: DataFrame) -> DataFrame:
    """Vectors and files per space, and in total ('all')."""
    return (
        index.rollup("space")
        .agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"))
        .select(F.coalesce("space", F.lit("all")).alias("space"), "chunks", "files")
    )


def fixed_batches(rows: DataFrame, key: str, id: str, size: int, fan_out: int | None = None) -> DataFrame:
    """Number the rows of each key and cut them into batches of ``size``.

    Rows go in the order of a hash of their id, which spreads one huge key over
    ``fan_out`` blocks (grows with the rows unless given). Adds ``row_no``
    (from 0) and ``batch_no``.
    """
    fan_out = fan_out or 1 + rows.count() // ROWS_PER_BLOCK
    digest = F.md5(F.col(id).cast("string"))
    block = F.pmod(F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * fan_out / 2**32), F.lit(fan_out))
    numbered = running(
        rows.withColumn("_digest", digest), [key], block, ["_digest", id], F.lit(1).cast("long"),
        "sum", "row_no", include_row=False,
    )
    row_no = F.col("row_no").cast("long")
    return numbered.drop("_digest").withColumn("row_no", row_no).withColumn(
        "batch_no", F.floor(F.col("row_no") / size).cast("long")
    )

