"""Near-duplicate documents: MinHash candidates, Bayesian pruning, exact verification.

Documents with the same shingle set are one class from the start, so exact
copies cost one row each and never meet. Signatures are cut into bands; classes
that agree on a band share a bucket. In the first rounds every member of a bucket is
compared with one leader of the bucket only, if it is not in the leader's
component yet; that ties groups of any size with a few pairs a member. The last
round looks at the pairs of a bucket that are still in different components;
there large buckets are cut into blocks of sets of about one size, apart for the largest
component and the rest, and pairs of blocks whose sizes and components allow a link are compared and verified in NumPy, so that links come out and not pairs. Together the rounds test every pair of every
bucket that is not already tied.

A test reads the signatures batch by batch. After each batch the pair is
dropped if the posterior probability that its similarity reaches the threshold
is below ``miss`` (uniform prior, so a binomial tail). What survives is decided
on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.llm.graph import components
from loomdex.llm.stored import narrow, stored

WORDS = 5
#: Similarity in hundredths that links two documents.
PERCENT = 75
#: 24 bands of 4: a pair at the threshold shares no band with probability (1 - .75^4)^24, about 1e-4.
BANDS, ROWS = 24, 4
#: Signature values read between two tests, and the posterior below which a pair is dropped.
BATCH, MISS = 32, 1e-4
#: Rounds of leaders, and members of a block in the last round.
LEADERS, BLOCK = 2, 512


def shingles(w: wd.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, in order of row and hash."""
    hashes = wd.word_hashes(w)
    at, row = wd.row_windows(w, k)
    found, rows = wd.window_hashes(hashes, k)[at], row
    size = np.diff(w.bounds)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = []
        for r in short:  # a short text is one shingle, told apart from longer ones by its length
            part = hashes[w.bounds[r] : w.bounds[r + 1]]
            whole.append(wd.mix(wd.window_hashes(part, len(part), seed=2) + np.uint64(len(part)))[0])
        found, rows = np.concatenate((found, np.array(whole, np.uint64))), np.concatenate((rows, short))
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return found[first], rows[first]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def sign(k: int, bands: int, rows: int):
    """Arrow batches of (key struct, text) to shingle counts, set hashes, signatures and band keys."""
    n = bands * rows
    factor, shift = wd.randoms(11, n), wd.randoms(12, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wd.words(batch.column(1), lower=True):
                found, row = shingles(w, k)
                counts = np.bincount(row, minlength=w.rows)
                full = np.flatnonzero(counts)
                starts = np.concatenate(([0], np.cumsum(counts[full])[:-1])).astype(np.int64)
                signature = np.zeros((w.rows, n), np.uint32)
                sets = np.zeros(w.rows, np.uint64)
                if len(full):
                    sets[full] = wd.mix(np.add.reduceat(wd.mix(found), starts) + counts[full].astype(np.uint64))
                    for j in range(n):
                        signature[full, j] = np.minimum.reduceat((found * factor[j] + shift[j]) >> np.uint64(32), starts)
                keys = np.zeros((w.rows, bands), np.uint64)
                for b in range(bands):
                    part = signature[:, b * rows : (b + 1) * rows].astype(np.uint64) + np.uint64(1)
                    keys[:, b] = wd.mix((part * factor[:rows]).sum(1, dtype=np.uint64) + wd.randoms(13, bands)[b])
                empty = counts == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.first, w.rows), pa.array(counts, pa.int64()),
                    pa.array(sets.view(np.int64), mask=empty),
                    pa.array([signature[i].tobytes() for i in range(w.rows)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(w.rows + 1, dtype=np.int32) * bands), signed(keys.ravel())),
                ], ["_key", "n_shingles", "set", "signature", "bands"])

    return run


def shingle_sets(k: int):
    """Arrow batches of (set, text) to (set, all shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wd.words(batch.column(1), lower=True):
                found, row = shingles(w, k)
                bounds = np.searchsorted(row, np.arange(w.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.rows), pa.ListArray.from_arrays(pa.array(bounds), signed(found))],
                    ["set", "hashes"])

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches in ``n`` at which similarity >= ``threshold`` is still credible.

    With a uniform prior P(similarity >= t | m of n match) is the chance of at
    most m successes in n + 1 tries at t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def survive(a: np.ndarray, b: np.ndarray, threshold: float, batch: int, miss: float) -> np.ndarray:
    """Which pairs of signature rows pass all tests; later batches are read for survivors only."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for to in range(batch, a.shape[1] + 1, batch):
        matches[alive] += (a[alive, to - batch : to] == b[alive, to - batch : to]).sum(1)
        alive = alive[matches[alive] >= least_matches(to, threshold, miss)]
    kept = np.zeros(len(a), bool)
    kept[alive] = True
    return kept


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), -1)


def pruned(pairs: DataFrame, classes: DataFrame, threshold: float, batch: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures pass the sequential test."""

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(survive(signatures(a), signatures(b), threshold, batch, miss) if len(a) else [], dtype=bool)

    one = classes.select(F.col("set").alias("a"), F.col("signature").alias("_sa"))
    two = classes.select(F.col("set").alias("b"), F.col("signature").alias("_sb"))
    return pairs.join(one, "a").join(two, "b").where(passes("_sa", "_sb")).select("a", "b")


def first_band(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The first band on which each pair of signature rows agrees."""
    return (a == b).reshape(len(a), a.shape[1] // rows, rows).all(2).argmax(1)


def block_links(threshold: float, batch: int, miss: float, rows: int, percent: int):
    """One pair of blocks of a bucket to links (a, b) between different components, decided on full sets.

    A pair that shares several buckets is looked at in that of its first common
    band. A row of the one block gives a link a component of the other at most.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        side, band = group.column("side").to_numpy(), group.column("band").to_numpy()
        sets, part = group.column("set").to_numpy(), group.column("component").to_numpy()
        sig = signatures(group.column("signature").to_pylist())
        lists = group.column("hashes").combine_chunks()
        flat, size = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
        end = np.cumsum(size)
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)  # 0: a block with itself
        a, b = [], []
        for i in left:
            other = right[(part[right] != part[i]) & ((side[i] < 0) | (sets[right] > sets[i]))]
            if not len(other):
                continue
            mine = np.broadcast_to(sig[i], (len(other), sig.shape[1]))
            other = other[survive(mine, sig[other], threshold, batch, miss)]
            other = other[first_band(mine[: len(other)], sig[other], rows) == band[i]]
            if not len(other):
                continue
            whole, theirs = flat[end[i] - size[i] : end[i]], [flat[end[j] - size[j] : end[j]] for j in other]
            met = np.concatenate(theirs)
            same = whole[np.minimum(np.searchsorted(whole, met), len(whole) - 1)] == met
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(size[other]) - size[other])
            linked = other[100 * both >= percent * (size[i] + size[other] - both)]
            _, once = np.unique(part[linked], return_index=True)
            a += [sets[i]] * len(once)
            b += sets[linked[once]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def meetings(rest: DataFrame, block: int) -> DataFrame:
    """Members of buckets (bucket, band, set, component, _class), once for each pair of blocks in which they meet others.

    The members of a bucket's largest component are tied to each other already: their blocks
    meet those of the other members only. A bucket of near copies with a few strangers
    so makes a few rows a copy, and not one for each block of copies.
    """
    parts = narrow(rest.groupBy("bucket", "component").agg(F.count("*").alias("_n")), "shares")
    largest = narrow(parts.groupBy("bucket").agg(F.max_by("component", F.struct("_n", "component")).alias("_top")), "largest")
    rest = rest.join(largest, "bucket").withColumn("_out", (F.col("component") != F.col("_top")).cast("int"))
    rest = narrow(rest.drop("_top"), "sided")
    blocks = [F.ceil(F.count(F.when(F.col("_out") == out, 1)) / block).cast("int").alias(f"_b{out}") for out in (0, 1)]
    counts = narrow(rest.groupBy("bucket", "_class").agg(*blocks), "counts")
    for step in (-1, 0, 1):
        near = counts.select("bucket", (F.col("_class") - step).alias("_class"), *[F.col(f"_b{out}").alias(f"_n{step + 1}{out}") for out in (0, 1)])
        rest = rest.join(near, ["bucket", "_class"], "left")
    # even numbers are blocks of the largest component
    own = F.pmod(F.xxhash64("set"), F.when(F.col("_out") == 1, F.col("_n11")).otherwise(F.col("_n10")))
    rest = narrow(rest.withColumn("_mine", (2 * own + F.col("_out")).cast("int")), "dealt")

    def meeting(step: int, out: int) -> Column:
        n = F.coalesce(F.col(f"_n{step + 1}{out}"), F.lit(0))
        met = (n > 0) if out else (n > 0) & (F.col("_out") == 1)
        others = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(step).alias("step"), (2 * i + out).alias("other")))
        return F.when(met, others).otherwise(F.array().cast("array<struct<step:int,other:int>>"))

    meets = F.concat(*[meeting(step, out) for step in (-1, 0, 1) for out in (0, 1)])
    step, other = F.col("_meets.step"), F.col("_meets.other")
    return rest.withColumn("_meets", F.explode(meets)).select(
        "bucket", "band", "set", "component", (F.col("_class") + F.least(step, F.lit(0))).alias("_low"), F.abs(step).alias("_up"),
        F.when(step > 0, F.col("_mine")).when(step < 0, other).otherwise(F.least("_mine", other)).alias("_i"),
        F.when(step > 0, other).when(step < 0, F.col("_mine")).otherwise(F.greatest("_mine", other)).alias("_j"),
        F.when(step != 0, -step).otherwise(F.signum(F.col("_mine") - other).cast("int")).alias("side"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough."""
    one = sets.select(F.col("set").alias("a"), F.col("hashes").alias("_ha"))
    two = sets.select(F.col("set").alias("b"), F.col("hashes").alias("_hb"))
    both = F.size(F.array_intersect("_ha", "_hb"))
    return pairs.join(one, "a").join(two, "b").where(
        100 * both >= percent * (F.size("_ha") + F.size("_hb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """Columns ``keep`` and n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...); options of ``groups``.

    A document's set holds its distinct ``k``-word shingles (A-Z lowered); a
    shorter one is one shingle. Documents link when their sets overlap by
    ``percent`` hundredths; ``component_id`` is the smallest doc_id reachable by
    links, ``kept`` says that it is the row's own. Null, empty and blank texts
    have an empty set, link with nothing and stand for themselves. A null doc_id
    never names a component that has another one. Repeated rows have one set,
    so they link; each is returned. An empty table gives no rows. Sets are
    compared by 64-bit hashes of their shingles, classes by a hash of the set.
    """
    found = groups(docs, keep, **options)
    return found.select(
        *[F.col(f"_key.{c}").alias(c) for c in keep], "n_shingles", "component_id",
        F.col("_key.doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id; rows without words all stay.

    Of a component without any doc_id the text of the smallest hash stays. Rows
    with words that are equal in doc_id and text come back once.
    """
    found = groups(docs, ("doc_id",), **options)
    place = F.struct(F.col("_key.doc_id").isNull().alias("none"), F.col("_key.doc_id").alias("doc_id"), F.col("_key._text").alias("text"))
    first = found.where("group is not null").groupBy("group").agg(F.min(place).alias("at")).select("at.doc_id", "at.text")
    chosen = narrow(first.select(F.col("doc_id").alias("_id"), F.col("text").alias("_mine")), "chosen")
    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    hashed = docs.where(worded).withColumn("_hash", F.xxhash64(text))
    met = hashed.join(chosen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mine")))
    return met.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns).union(docs.where(~worded))


def groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), k: int = WORDS, percent: int = PERCENT, bands: int = BANDS,
           rows: int = ROWS, batch: int = BATCH, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(_key, n_shingles, group, component_id) for every row; ``_key`` holds ``keep``, doc_id and a hash of the text."""
    key = tuple(dict.fromkeys(("doc_id", *keep)))
    source = docs.select(
        F.struct(*key, F.xxhash64(F.col("text").cast("string")).alias("_text")).alias("_key"),
        F.col("text").cast("string").alias("text"))
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, n_shingles long, set long, signature binary, bands array<long>"
    found = stored(source.mapInArrow(sign(k, bands, rows), schema), "signatures")
    threshold = percent / 100

    # one row a class: its signature and the row that stands for it
    rep = F.min(F.struct(F.col("_key.doc_id").isNull().alias("none"), F.col("_key.doc_id").alias("doc_id"), F.col("_key._text").alias("text")))
    named = narrow(found.where("set is not null").groupBy("set").agg(rep.alias("rep")), "named")
    classes = found.where("set is not null").select("set", "_key", "n_shingles", "signature").join(named, "set").where(
        F.col("_key.doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_key._text") == F.col("rep.text")))
    classes = stored(classes.dropDuplicates(["set"]).select("set", "rep", "n_shingles", "signature"), "classes")

    shared = found.where("set is not null").select("set", F.posexplode("bands").alias("band", "bucket")).distinct()
    members = stored(shared, "members")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = narrow(buckets, "buckets")
    # only members that share a bucket go on
    placed = narrow(members.join(buckets, "bucket").withColumn("component", F.col("set")), "placed")

    # full sets of the classes in surviving pairs; a text is read again once, and only where a new class turns up
    def sets_of(needed: DataFrame, known: DataFrame | None) -> DataFrame:
        if known is not None:
            needed = narrow(needed.join(known.select("set"), "set", "left_anti"), "needed")
            if needed.isEmpty():
                return known
        needed = classes.join(needed, "set").select("set", F.col("rep.doc_id").alias("_id"), F.col("rep.text").alias("_hash"))
        texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).withColumn("_mine", F.xxhash64("text"))
        met = texts.join(
            needed.hint("shuffle_hash"), texts["_mine"].eqNullSafe(needed["_hash"]) & texts["_doc"].eqNullSafe(needed["_id"]))
        found = met.select("set", "text").mapInArrow(shingle_sets(k), "set long, hashes array<long>")
        found = stored(found.dropDuplicates(["set"]), "sets")
        return found if known is None else known.union(found)

    def untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return ordered if tested is None else ordered.join(tested, ["a", "b"], "left_anti")

    links, tested, tied, sets = None, None, None, None

    def settle(pairs: DataFrame) -> None:
        """Verify pairs, and tie what they link."""
        nonlocal links, tested, tied, placed, sets
        tested = pairs if tested is None else tested.union(pairs)
        if pairs.isEmpty() and tied is not None:
            return
        sets = sets_of(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), sets)
        more = narrow(verified(pairs, sets, percent), "links")
        if more.isEmpty() and tied is not None:
            return
        links = more if links is None else links.union(more)
        tied = narrow(components(links), "parts")
        now = placed.select("bucket", "band", "set", "n").join(tied.withColumnRenamed("node", "set"), "set", "left").withColumn(
            "component", F.coalesce("component", "set"))
        now = narrow(now, "now")
        mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        placed = narrow(now.join(narrow(mixed.select("bucket"), "mixed"), "bucket"), "placed")

    for turn in range(LEADERS):
        # the first leader is one for all buckets that have it, later ones are drawn for each bucket
        rank = F.xxhash64("set") if turn == 0 else F.xxhash64("set", "bucket", F.lit(turn))
        leaders = placed.groupBy("bucket").agg(F.min_by(F.struct("set", "component"), rank).alias("leader"))
        pairs = placed.join(narrow(leaders, "leaders"), "bucket").where("component != leader.component")
        pairs = untested(pairs.select(F.col("set").alias("a"), F.col("leader.set").alias("b")), tested)
        settle(narrow(pruned(pairs, classes, threshold, batch, miss), "pairs"))

    # the pairs of what is still mixed: a bucket of two has been tested, larger ones are compared block by block.
    # sets that can link differ in size by the threshold at most, so by one size class: others never meet
    sizes = classes.select("set", F.floor(F.log("n_shingles") / -log(min(threshold, 0.99))).cast("int").alias("_class"))
    rest = narrow(placed.where("n > 2").join(sizes, "set"), "rest")
    sets = sets_of(rest.select("set").distinct(), sets)
    paired = meetings(rest, block)
    last = paired.join(classes.select("set", "signature"), "set").join(sets, "set").groupBy("bucket", "_low", "_up", "_i", "_j").applyInArrow(
        block_links(threshold, batch, miss, rows, percent), "a long, b long")
    last = narrow(last, "links")
    if not last.isEmpty():
        tied = narrow(components(links.union(last)), "parts")

    whole = classes.select("set", F.col("rep.doc_id").alias("_id")).join(tied.withColumnRenamed("node", "set"), "set")
    smallest = narrow(whole.groupBy("component").agg(F.min("_id").alias("_least")), "smallest")
    ids = narrow(whole.join(smallest, "component").select("set", "_least", "component"), "ids")
    result = found.join(named.select("set", F.col("rep.doc_id").alias("_own")), "set", "left").join(ids, "set", "left")
    return result.select(
        "_key", "n_shingles", F.coalesce("component", "set").alias("group"),
        F.coalesce("_least", "_own", F.col("_key.doc_id")).alias("component_id"))
