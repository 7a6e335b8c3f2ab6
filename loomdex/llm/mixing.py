"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed pseudo-random order. An
entry's virtual finish time is the words its queue has brought so far divided
by the source's target; the queues are served in order of finish times, and
service stops when the total budget is used up. Because all finish times run
on one scale, every source reaches its target at the same moment.

Only column functions are used. Running sums over one source and over the
whole mix go through blocks and blocks of blocks, so no source and no sort is
one task's work; texts are reduced to their size in the first step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights in turn for the sources in order of their names.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words; and at most so many times a document or a source.
SHARE, EPOCHS = 1.5, 2
BLOCK_ROWS = 1000


def running_sum(rows: DataFrame, key: list[str], block: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` summed over the rows of ``key`` up to and with this one.

    ``block`` (long) must not fall along ``order``. Blocks are summed first, then
    runs of a thousand blocks, so the longest window holds a millionth of a key.
    """
    blocks = rows.groupBy(*key, block).agg(F.sum(value).alias("_s"))
    blocks = materialize(blocks.withColumn("_run", F.floor(F.col(block) / 1000)), "blocks")
    runs = blocks.groupBy(*key, "_run").agg(F.sum("_s").alias("_t"))
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*key, "_run", F.sum("_t").over(earlier.partitionBy(*key).orderBy("_run")).alias("_before"))
    within = F.sum("_s").over(earlier.partitionBy(*key, "_run").orderBy(block))
    carried = blocks.withColumn("_in", within).join(runs, [*key, "_run"]).select(
        *key, block, (F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("_carry"))
    upto = W.partitionBy(*key, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_upto", F.sum(value).over(upto)).join(carried, [*key, block])
        .withColumn(name, F.col("_upto") + F.col("_carry")).drop("_upto", "_carry")
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size), one row per source.

    Weights go round in order of the keys. The budget is shared by weight; a
    source stops at ``epochs`` times its size and what it cannot use is shared
    again, which is one level for all open sources, found from running sums over
    the sources in order of size per weight.
    """
    ranked = sizes.withColumn("_n", F.row_number().over(W.orderBy("source_key")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("double")
    total = W.partitionBy()
    upto = W.orderBy("_ratio", "_n").rowsBetween(W.unboundedPreceding, -1)  # the sources that are full first
    levels = (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(total))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
        .withColumn("_water", F.max("_level").over(total))  # rises until the first source that stays open, then falls
    )
    target = F.least("_cap", F.col("_w") * F.col("_water"))
    return levels.select("source_key", "source_size", target.alias("target"))


def source_key() -> Column:
    """The name of a row's source, prefixed so that null sorts after every name."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: str = "mix", block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text, ...).

    ``size`` is the number of words, 0 for null. ``taken`` is ``size`` times how
    often the mix takes the document, at most ``epochs`` times. The order within
    a source is that of md5 over ``seed`` and doc_id, so reruns agree; rows that
    share a doc_id are ordered by size, and equal rows are taken together as far
    as their positions go. Null sources are one source, last in order; empty
    texts take nothing; an empty table gives no rows. Other columns are ignored.
    """
    key = source_key()
    keep = tuple(dict.fromkeys(keep))
    rows = materialize(docs.select(
        *dict.fromkeys(("doc_id", *keep)), key.alias("source_key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
    ), "sizes")
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = materialize(sources, "sources")
    total = sources.agg(F.sum("source_size"), F.sum("_rows")).first()
    n_rows = int(total[1] or 0)
    plan = materialize(targets(sources.select("source_key", "source_size"), weights, share, epochs), "targets")
    # the share of a row's md5 in [0, 1) names its block; every pass over the source is a range of blocks of its own
    n_blocks = max(1, n_rows // block_rows)
    ahead = F.floor(F.conv(F.substring("_key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48)) * F.lit(float(n_blocks)))
    rows = rows.withColumn("_block", ahead.cast("long"))
    order = [F.col("_key"), F.col("doc_id"), F.col("size")]
    once = running_sum(rows, ["source_key"], "_block", order, "size", "_sum").join(plan, "source_key")
    once = materialize(once, "queues")
    # pass e comes after e whole passes, so its running sum needs no second queue
    finish = [(F.col("_sum") + F.lit(e) * F.col("source_size")) / F.col("target") for e in range(epochs)]
    slot = [F.floor(f * F.lit(float(n_blocks))).cast("long") for f in finish]
    entries = F.inline(F.array(*[F.struct(F.lit(e).alias("_pass"), finish[e].alias("_finish"), slot[e].alias("_slot"))
                                 for e in range(epochs)]))
    queue = once.where("size > 0 and target > 0").select("doc_id", "source_key", "_key", "size", entries)
    # slots are ranges of finish times; the sums of slots tell in which of them the budget ends
    slots = queue.groupBy("_slot").agg(F.sum("size").alias("_s"))
    slots = materialize(slots.withColumn("_run", F.floor(F.col("_slot") / 1000)), "slots")
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    runs = slots.groupBy("_run").agg(F.sum("_s").alias("_t"))
    runs = runs.select("_run", F.coalesce(F.sum("_t").over(earlier.orderBy("_run")), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_s").over(earlier.partitionBy("_run").orderBy("_slot")), F.lit(0))
    starts = slots.withColumn("_in", within).join(runs, "_run").withColumn("_start", F.col("_before") + F.col("_in"))
    budget = F.lit(float(share)) * F.lit(int(total[0] or 0))
    ends = starts.where(F.col("_start") < budget).agg(F.max_by(F.struct("_slot", "_start"), "_slot").alias("at")).first().at
    if ends is None:
        return once.select(*keep, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    place = ["_finish", "_key", "source_key", "doc_id", "size", "_pass"]
    upto = W.orderBy(*place).rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.lit(ends["_start"])
    cut = (
        queue.where(F.col("_slot") == ends["_slot"]).withColumn("_at", at).where(F.col("_at") < budget)
        .agg(F.max(F.struct(*place)).alias("last")).first().last
    )
    last = F.struct(*[F.lit(cut[c]).cast(queue.schema[c].dataType).alias(c) for c in place])
    mine = [F.struct(finish[e].alias("_finish"), "_key", "source_key", "doc_id", "size", F.lit(e).alias("_pass"))
            for e in range(epochs)]
    times = sum((F.when((F.col("target") > 0) & (mine[e] <= last), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    return once.select(*keep, "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target and taken; options of ``mix``.

    Columns of ``docs`` that have one of these names give way to them.

    Texts travel once, to meet what was decided on their sizes. Rows are met by
    doc_id, source and a hash of the text; rows equal in all three are numbered,
    and each that the mix takes comes back with what was taken of it.
    """
    made = ("size", "source_size", "target", "taken")
    hashed = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string"))).withColumn("_queue", source_key())
    taken = mix(hashed, keep=("doc_id", "_queue", "_hash"), **options).where("taken > 0")
    taken = taken.groupBy("doc_id", "_queue", "_hash").agg(
        *[F.first(c).alias(f"_{c}") for c in made[:3]], F.sort_array(F.collect_list("taken"), asc=False).alias("_all"))
    taken = materialize(taken.withColumnsRenamed({"doc_id": "_id", "_queue": "_from", "_hash": "_mine"}), "taken")
    met = hashed.join(taken.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_queue") == F.col("_from")) & (
        F.col("_hash") == F.col("_mine")))
    nth = F.row_number().over(W.partitionBy("doc_id", "_queue", "_hash").orderBy("_hash"))
    met = met.withColumn("_taken", F.get("_all", nth - 1)).where("_taken is not null")
    return met.select(*[c for c in docs.columns if c not in made], *[F.col(f"_{c}").alias(c) for c in made])
