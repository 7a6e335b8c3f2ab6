"""Near-equal chunks: drop each chunk that has a near-equal one with a smaller id.

An exact similarity join without all pairs. Equal vectors are collapsed first.
Every distinct vector then lives in the cell of its nearest centre, and visits
the lower cells that can hold a vector within the wanted distance: for unit
vectors x, y with y in cell c, |x - y| <= r implies
(|x-c|^2 - |x-home|^2) / (2 |c-home|) <= r. So two cells meet once, in the lower
one, and both sides look for smaller ids there.

Cells are cut into blocks, and a vector is moved once for every block that it
meets. So cells and blocks grow with the table and their number does not: rows
are moved in proportion to the table, until blocks reach ``BLOCK_BYTES``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.operators.ann import centre_table, sampled_centres
from loomdex.operators.knn import CELLS_AT_ONCE, as_matrix, exact_cosines, norms_of, slack, unit
from loomdex.session import materialize

CELLS = 32  # more only where a cell would be larger than a block of BLOCK_BYTES
ROWS_PER_BLOCK = 1024  # at least
BLOCK_BYTES = 32 << 20  # of single precision; a task holds two blocks
SAMPLE_PER_CELL, SAMPLE_BYTES, ROUNDS = 256, 64 << 20, 8
SLAB = 2048  # vectors of one side that meet the other at one time


def representatives(chunks: DataFrame) -> DataFrame:
    """One row per distinct vector, with the smallest id that has it."""
    return chunks.where("embedding is not null").groupBy("space", "embedding").agg(F.min("chunk_id").alias("chunk_id"))


def block_rows(n: int, width: int) -> int:
    return max(ROWS_PER_BLOCK, min(n // CELLS, BLOCK_BYTES // (4 * width)))


def spread_centres(reps: DataFrame, cells: int, width: int) -> np.ndarray:
    """Centres of k-means over a bounded sample; they decide how much is moved, never what is found."""
    rows = max(cells, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // (8 * width)))
    table = centre_table(sampled_centres(reps, rows))
    matrix = as_matrix(table["embedding"], width)
    sample = unit(matrix, norms_of(matrix)).astype(np.float64)
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        parts = np.array_split(sample, 1 + len(sample) * len(centres) // CELLS_AT_ONCE)
        home = np.concatenate([(0.5 * (centres * centres).sum(axis=1) - part @ centres.T).argmin(axis=1) for part in parts])
        sums, held = np.zeros_like(centres), np.bincount(home, minlength=len(centres))[:, None]
        np.add.at(sums, home, sample)
        centres = np.where(held > 0, sums / np.maximum(held, 1), centres)
    return centres


def with_cells(reps: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """Add ``home`` and ``cells``, the home and the lower cells that can hold a partner."""
    gaps = np.array([norms_of(centres - c) for c in centres])
    shared = reps.sparkSession.sparkContext.broadcast((centres, gaps))
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6

    def run(batches):
        centres, gaps = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                vectors = as_matrix(batch["embedding"], centres.shape[1])
                x = unit(vectors, norms_of(vectors)).astype(np.float64)
                squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2.0 * x @ centres.T
                home = squares.argmin(axis=1)
                lead = squares - squares[np.arange(len(x)), home][:, None]
                met = (lead <= 2.0 * radius * gaps[home] + 1e-5) & (np.arange(len(centres)) < home[:, None])
                met[np.arange(len(x)), home] = True
                offsets = np.concatenate([[0], met.sum(axis=1).cumsum()])
                cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(met)[1], pa.int32()))
                yield batch.append_column("home", pa.array(home, pa.int32())).append_column("cells", cells)

    schema = T.StructType(
        [*reps.schema, T.StructField("home", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]
    )
    return reps.mapInArrow(run, schema)


def dealt(placed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors at home and as guests (of their own cell too), a row for each block of the other side."""
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("homes"))
    guests = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.ceil(F.count("*") / block).cast("int").alias("guests")
    )
    sizes = F.broadcast(homes.join(F.broadcast(guests), "cell"))  # a row per centre at most

    def own(n):
        return F.pmod(F.xxhash64("chunk_id"), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    at_home = placed.select("chunk_id", "embedding", F.col("home").alias("cell")).join(sizes, "cell").select(
        "cell", own("homes").alias("hb"), every("guests").alias("gb"), "chunk_id", "embedding")
    visiting = placed.select("chunk_id", "embedding", "home", F.explode("cells").alias("cell")).join(sizes, "cell").select(
        "cell", every("homes").alias("hb"), own("guests").alias("gb"), "chunk_id", "embedding",
        (F.col("home") != F.col("cell")).alias("foreign"))
    return at_home, visiting


class Side(NamedTuple):
    """Vectors in the order of their ids; ``order`` numbers the ids of both sides."""

    order: np.ndarray
    ids: np.ndarray
    raw: np.ndarray
    norms: np.ndarray
    units: np.ndarray

    def only(self, rows: np.ndarray) -> Side:
        return Side(*(part[rows] for part in self))


def first_partners(askers: Side, held: Side, threshold: float) -> pd.DataFrame:
    """``chunk_id, duplicate_of``: the smallest of the held ids that is near-equal and smaller, per asker that has one."""
    at_least = np.float32(threshold - slack(held.raw.shape[1]))
    found = [pd.DataFrame(columns=["chunk_id", "duplicate_of"], dtype=object)]
    waiting = np.arange(len(askers.order))
    for i in range(0, len(held.order), SLAB):
        slab = held.only(slice(i, i + SLAB))
        # later slabs hold larger ids: who has met a partner, or all smaller ids, is done
        waiting = waiting[askers.order[waiting] > slab.order[0]]
        served = np.zeros(len(waiting), bool)
        step = max(1, CELLS_AT_ONCE // SLAB)
        for j in range(0, len(waiting), step):
            some = waiting[j : j + step]
            cosines = askers.units[some] @ slab.units.T
            if askers.order[some[0]] <= slab.order[-1]:
                cosines[slab.order[None, :] >= askers.order[some][:, None]] = -2.0
            rows = np.flatnonzero(cosines.max(axis=1) >= at_least)
            near = cosines[rows] >= at_least
            while len(rows):
                first = near.argmax(axis=1)
                asking = some[rows]
                exact = exact_cosines(askers.raw[asking], slab.raw[first], askers.norms[asking], slab.norms[first])
                hit = exact >= threshold
                found.append(pd.DataFrame({"chunk_id": askers.ids[asking[hit]], "duplicate_of": slab.ids[first[hit]]}))
                served[j + rows[hit]] = True
                near[np.arange(len(rows)), first] = False
                left = ~hit & near.any(axis=1)
                rows, near = rows[left], near[left]
        waiting = waiting[~served]
        if not len(waiting):
            break
    return pd.concat([f for f in found if len(f)] or found)


def smallest_partner(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """``chunk_id, duplicate_of``: smallest id among the near-equal vectors, where it is smaller."""
    id_type = placed.schema["chunk_id"].dataType.simpleString()
    keys = ["cell", "hb", "gb"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk_id", left.schema.field("chunk_id").type), ("duplicate_of", left.schema.field("chunk_id").type)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = len(left["embedding"][0])
        ids = [t["chunk_id"].combine_chunks().to_pandas().to_numpy() for t in (left, right)]
        order = pd.factorize(np.concatenate(ids), sort=True)[0]

        def side(table: pa.Table, ids: np.ndarray, order: np.ndarray) -> tuple[Side, np.ndarray]:
            at = np.argsort(order, kind="stable")
            raw = as_matrix(table["embedding"], width)[at]
            norms = norms_of(raw)
            return Side(order[at], ids[at], raw, norms, unit(raw, norms)), at

        homes, _ = side(left, ids[0], order[: len(ids[0])])
        guests, at = side(right, ids[1], order[len(ids[0]) :])
        found = [first_partners(guests, homes, threshold)]
        foreign = right["foreign"].to_numpy()[at]
        if foreign.any():  # those of the cell itself have asked as guests
            found.append(first_partners(homes, guests.only(foreign), threshold))
        return pa.Table.from_pandas(pd.concat([f for f in found if len(f)] or found), schema, preserve_index=False)

    homes, guests = dealt(placed, block)
    homes, guests = homes.toDF(*homes.columns), guests.toDF(*guests.columns)
    pairs = homes.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(
        meet, f"chunk_id {id_type}, duplicate_of {id_type}"
    )
    return pairs.groupBy("chunk_id").agg(F.min("duplicate_of").alias("duplicate_of"))


def near_duplicates(chunks: DataFrame, threshold: float, cells: int | None = None) -> DataFrame:
    """``chunk_id, duplicate_of`` of every chunk that a smaller near-equal id makes redundant.

    Near-equal: same space and width, and cosine >= ``threshold``. Zero vectors equal nothing.
    ``cells`` follows from the number of distinct vectors unless given, and changes no result.
    """
    rows = chunks.select("chunk_id", "space", "embedding").where(
        F.exists("embedding", lambda v: v != 0)
    )
    reps = materialize(representatives(rows), "representatives")
    partner = None
    # a null id is smaller than none, and a vector with null or non-finite components is near to none
    sought = reps.where(F.col("chunk_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    for kind in sought.groupBy("space", F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect():
        alike = sought.where((F.col("space").eqNullSafe(F.lit(kind.space))) & (F.size("embedding") == kind.width))
        block = block_rows(kind.n, kind.width)
        centres = spread_centres(alike, cells or max(1, min(CELLS, kind.n // ROWS_PER_BLOCK), kind.n // block), kind.width)
        placed = materialize(with_cells(alike.drop("space"), centres, threshold), "placed")
        found = smallest_partner(placed, threshold, block)
        partner = found if partner is None else partner.unionByName(found)
    if partner is None:
        partner = reps.select("chunk_id", F.col("chunk_id").alias("duplicate_of")).limit(0)
    resolved = reps.join(partner, "chunk_id", "left").select(
        "space", "embedding", F.least("chunk_id", "duplicate_of").alias("duplicate_of")
    )
    return (
        rows.join(resolved, ["space", "embedding"])
        .where(F.col("duplicate_of") < F.col("chunk_id"))
        .select("chunk_id", "duplicate_of")
    )


def drop_near_duplicates(chunks: DataFrame, threshold: float, cells: int | None = None) -> DataFrame:
    return chunks.join(near_duplicates(chunks, threshold, cells).select("chunk_id"), "chunk_id", "left_anti")
