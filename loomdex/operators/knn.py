"""Nearest chunks per query by cosine distance, exact.

The index is read once. Up to a checked bound of queries it is never shuffled:
every task holds the query matrix, multiplies it with each Arrow batch of
vectors and keeps the best k per query; only those candidates are shuffled, by
query. Larger query sets never come to the driver: groups of queries meet slabs
of vectors in tiles, and the best of each tile are merged. Vectors move once for
each group, so a group is as large as a task can hold.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions.constants import DEFAULT_K
from loomdex.operators.filters import columns_of, compile_filter, metadata_filter
from loomdex.session import materialize

MAX_BROADCAST_QUERIES = 8192
MAX_BROADCAST_BYTES = 128 << 20
GROUP_ROWS, GROUP_HITS = 1 << 17, 1 << 20  # query rows and kept hits of a tile, beside MAX_BROADCAST_BYTES
MOST_K = 256  # of a query's k counts for the size of its group
CELLS_AT_ONCE = 4 << 20  # similarities held at one time
CACHED = 1 << 18  # of which so many are made at a stroke, as a core's cache holds
ROWS_AT_ONCE = 1024
EXACT_AT_ONCE = 1 << 16  # pairs recomputed at one time
PAIRS_AT_ONCE = 1 << 19  # pairs held before the best of them are kept, however many copies of a vector meet the queries
CARRIED = "where_"  # before the names of columns that only filters read


@dataclass
class QueryBlock:
    """Query rows grouped by what they may meet; one query may have several rows."""

    ids: pa.Array  # distinct query ids
    k: np.ndarray  # per distinct query
    owner: np.ndarray  # query row -> distinct query
    vectors: dict  # width -> (matrix, norms, unit vectors)
    place: np.ndarray  # query row -> row of its width's matrix
    lanes: dict  # scope or None -> {(where, width): query rows}

    @classmethod
    def of(cls, table: pa.Table) -> QueryBlock:
        rows = table.filter(pc.is_valid(table["embedding"])).combine_chunks()
        codes, ids = pd.factorize(rows["query_id"].to_pandas())
        k = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(k, codes, rows["k"].to_numpy())
        widths = pc.list_value_length(rows["embedding"]).to_numpy()
        vectors, place = {}, np.zeros(len(codes), dtype=np.int64)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            lists = rows["embedding"].take(pa.array(at))
            matrix = as_matrix(lists, int(width))
            norms = norms_of(matrix)
            units = unit(matrix, norms)
            if lists.type.value_type == pa.float32():  # holds the same in half the room
                matrix = matrix.astype(np.float32)
            vectors[int(width)] = matrix, norms, units
            place[at] = np.arange(len(at))
        lanes = {}
        wheres = rows["where"].to_pylist()
        for row, scopes in enumerate(rows["scopes"].to_pylist()):
            for scope in [None] if scopes is None else scopes:
                lane = lanes.setdefault(scope, {})
                lane.setdefault((wheres[row], int(widths[row])), []).append(row)
        lanes = {
            s: {key: np.array(at) for key, at in lane.items()} for s, lane in lanes.items()
        }
        return cls(pa.array(ids, rows["query_id"].type), k, codes, vectors, place, lanes)


def as_matrix(lists, width: int) -> np.ndarray:
    flat = pc.list_flatten(lists)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    if len(flat) != len(lists) * width or (pc.list_value_length(lists).to_numpy(zero_copy_only=False) != width).any():
        raise ValueError(f"vectors of other widths than {width} among the rows")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def norms_of(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def unit(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, for matrix products that only preselect."""
    return (matrix / np.where(norms == 0, 1.0, norms)[:, None]).astype(np.float32)


def slack(width: int) -> float:
    """Twice the most a product of two such vectors can be off the exact cosine."""
    return (width + 8) * 2.0**-23


def exact_cosines(a, b, norm_a, norm_b) -> np.ndarray:
    """Row-wise cosine, 0 for zero vectors; the value of a pair never depends on its batch."""
    out = np.zeros(len(a))
    for i in range(0, len(a), EXACT_AT_ONCE):
        s = slice(i, i + EXACT_AT_ONCE)
        size = norm_a[s] * norm_b[s]
        np.divide((a[s] * b[s]).sum(axis=1), size, out=out[s], where=size > 0)
    return out


def parted(queries: np.ndarray, rows: int):
    """Slices of ``queries`` whose similarities to a stroke of ``rows`` are held at one time."""
    step = max(1, min(CELLS_AT_ONCE, CACHED) // max(1, min(rows, ROWS_AT_ONCE)))
    for i in range(0, len(queries), step):
        yield queries[i : i + step]


def pairs_in(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, quick where little is: eight at a time are looked at first."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, mask.shape[1])


def reaching(units: np.ndarray, asked: np.ndarray, needed: np.ndarray, most: int, off: float):
    """Pairs (rows, queries) with products within ``off`` of what each query needs; where that is open, of its ``most``-th best."""
    step = max(ROWS_AT_ONCE, 4 * most)
    for i in range(0, len(units), step):
        sims = units[i : i + step] @ asked.T
        open_ = np.flatnonzero(np.isneginf(needed))
        if len(open_) and len(sims) > most:
            needed[open_] = np.partition(sims[:, open_], len(sims) - most, axis=0)[len(sims) - most]
        r, q = pairs_in(sims >= (needed - off).astype(np.float32))
        if len(r):
            yield r + i, q


class BestSoFar:
    """The k nearest (distance, chunk id) per query, and per scope if asked, seen by a task."""

    once = False  # whether a chunk counts once for a query, however many of its vectors meet it

    def __init__(self, block: QueryBlock, per_scope: bool):
        self.block, self.per_scope = block, per_scope
        self.by = ["q", "scope"] if per_scope else ["q"]
        self.rows = None
        self.cuts, self.bars = {}, {}  # scope or None -> similarity a newcomer has to reach, distance it may have, per query

    def cut(self, scope):
        key = scope if self.per_scope else None
        return self.cuts.setdefault(key, np.full(len(self.block.ids), -np.inf))

    def bar(self, scope):
        """The distance that a newcomer may have at most, per query."""
        key = scope if self.per_scope else None
        return self.bars.setdefault(key, np.full(len(self.block.ids), np.inf))

    def offer(self, frames: list[pd.DataFrame]) -> None:
        """Put newcomers among the best; queries without any are not looked at."""
        if not frames:
            return
        rows, rest = pd.concat(frames, ignore_index=True), None
        if self.rows is not None:
            met = np.zeros(len(self.block.ids), bool)
            met[rows["q"].to_numpy()] = True
            met = met[self.rows["q"].to_numpy()]
            rows, rest = pd.concat([self.rows[met], rows], ignore_index=True), self.rows[~met]
        if not (self.once or self.per_scope):  # first by distance alone, which needs no ids
            q, distance = rows["q"].to_numpy(), rows["distance"].to_numpy()
            order = np.lexsort((distance, q))
            start = np.flatnonzero(np.diff(q[order], prepend=-1))
            size = np.diff(start, append=len(q))
            last = distance[order[start + np.minimum(size, self.block.k[q[order[start]]]) - 1]]
            rows = rows.take(order[distance[order] <= np.repeat(last, size)])
        rows = rows.sort_values([*self.by, "distance", "chunk_id"], ignore_index=True)
        if self.once:
            rows = rows.drop_duplicates(["q", "scope", "chunk_id"], ignore_index=True)
        place = rows.groupby(self.by, sort=False).cumcount().to_numpy()
        k = self.block.k[rows["q"].to_numpy()]
        best, last = rows[place < k], rows[place == k - 1]
        self.rows = pd.concat([rest, best], ignore_index=True) if rest is not None and len(rest) else best.reset_index(drop=True)
        for scope, group in last.groupby("scope") if self.per_scope else [(None, last)]:
            q, distance = group["q"].to_numpy(), group["distance"].to_numpy()
            self.cut(scope)[q], self.bar(scope)[q] = 1.0 - distance, distance

    def scan(self, batch) -> None:
        """Offer all rows of one Arrow batch or table with chunk_id, scope, embedding."""
        if batch["embedding"].null_count:
            batch = batch.filter(pc.is_valid(batch["embedding"]))
        ids = batch["chunk_id"].to_pandas()
        scopes = batch["scope"].to_pandas()
        widths = pc.list_value_length(batch["embedding"]).to_numpy(zero_copy_only=False)
        columns = self.carried(batch)
        masks, frames, pairs = {}, [], 0
        for scope, at in scopes.groupby(scopes).indices.items():
            for lane in (self.block.lanes.get(scope), self.block.lanes.get(None)):
                for (where, width), queries in (lane or {}).items():
                    rows = self.passing(where, at[widths[at] == width], columns, masks, len(ids))
                    if len(rows):
                        vectors = as_matrix(batch["embedding"].take(pa.array(rows)), width)
                        for frame in self.candidates(scope, ids, rows, vectors, queries, width):
                            frames.append(frame)
                            pairs += len(frame)
                            if pairs >= PAIRS_AT_ONCE:
                                self.offer(frames)
                                frames, pairs = [], 0
        self.offer(frames)

    @staticmethod
    def carried(batch) -> dict:
        """The columns that filters read."""
        return {c.removeprefix(CARRIED): batch[c].to_pandas() for c in batch.schema.names if c.startswith(CARRIED)}

    @staticmethod
    def passing(where: str | None, rows: np.ndarray, columns: dict, masks: dict, size: int) -> np.ndarray:
        """Those of ``rows`` that pass a query's own filter; each filter is evaluated once a batch."""
        if where is None:
            return rows
        if where not in masks:
            masks[where] = filter_mask(where, columns, size)
        return rows[masks[where][rows]]

    def repeats(self, ids, rows) -> int:
        """Rows that may take the place of another chunk among the best ones."""
        return len(rows) - ids.iloc[rows].nunique(dropna=False) if self.once else 0

    def candidates(self, scope, ids, rows, vectors, queries, width):
        norms = norms_of(vectors)
        units, spare = unit(vectors, norms), self.repeats(ids, rows)
        met, pairs = [], 0
        for part in parted(queries, len(rows)):
            most = int(self.block.k[self.block.owner[part]].max()) + spare
            needed = self.cut(scope)[self.block.owner[part]].copy()
            for r, q in reaching(units, self.block.vectors[width][2][self.block.place[part]], needed, most, slack(width)):
                met.append((r, part[q]))
                pairs += len(r)
                if pairs >= EXACT_AT_ONCE:
                    yield from self.exact(scope, ids, rows, vectors, norms, *map(np.concatenate, zip(*met)), width)
                    met, pairs = [], 0
        if met:
            yield from self.exact(scope, ids, rows, vectors, norms, *map(np.concatenate, zip(*met)), width)

    def exact(self, scope, ids, rows, vectors, norms, r, asking, width):
        """Those pairs of rows of the batch and query rows that are near enough by exact distance."""
        matrix, query_norms, _ = self.block.vectors[width]
        for at in range(0, len(r), EXACT_AT_ONCE):
            m, n = r[at : at + EXACT_AT_ONCE], self.block.place[asking[at : at + EXACT_AT_ONCE]]
            owner = self.block.owner[asking[at : at + EXACT_AT_ONCE]]
            distance = 1.0 - exact_cosines(vectors[m], matrix[n], norms[m], query_norms[n])
            near = distance <= self.bar(scope)[owner]
            if near.any():
                yield pd.DataFrame({"q": owner[near], "chunk_id": ids.to_numpy()[rows[m[near]]], "scope": scope, "distance": distance[near]})

    def result(self, chunk_type) -> pa.RecordBatch:
        rows = self.rows
        if rows is None:
            rows = pd.DataFrame(columns=["q", "chunk_id", "scope", "distance"], dtype=object)
        q = rows["q"].to_numpy(dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                self.block.ids.take(pa.array(q)),
                pa.array(rows["chunk_id"].to_numpy(), chunk_type),
                pa.array(rows["scope"].to_numpy(), pa.string()),
                pa.array(rows["distance"].to_numpy(dtype=np.float64)),
                pa.array(self.block.k[q].astype(np.int32)),
            ],
            names=["query_id", "chunk_id", "scope", "distance", "k"],
        )


def filter_mask(where: str, columns: dict, size: int) -> np.ndarray:
    """Rows that pass a query's own filter."""
    mask = compile_filter(json.loads(where), lambda name: columns[name])
    return np.ones(size, dtype=bool) if mask is None else mask.to_numpy(dtype=bool)


def query_rows(queries: DataFrame, k: int, extra: int) -> DataFrame:
    """Fill in the optional columns ``k``, ``scopes`` (null = all) and ``where`` (JSON)."""
    have = set(queries.columns)
    k_column = F.coalesce(F.col("k"), F.lit(k)) if "k" in have else F.lit(k)
    return queries.select(
        "query_id",
        "embedding",
        (k_column + extra).cast("int").alias("k"),
        (F.col("scopes") if "scopes" in have else F.lit(None)).cast("array<string>").alias("scopes"),
        (F.col("where") if "where" in have else F.lit(None)).cast("string").alias("where"),
    ).where("k > 0")


def filter_names(batches):
    """Filters (JSON) to the names of the columns they read."""
    for batch in batches:
        named = set().union(*(columns_of(json.loads(w)) for w in batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(named), pa.string())], ["name"])


def few(rows: DataFrame) -> pa.Table | None:
    """All query rows, if they are few and small enough to go to every task."""
    table = rows.limit(MAX_BROADCAST_QUERIES + 1).toArrow()
    size = 20 * (pc.sum(pc.list_value_length(table["embedding"])).as_py() or 0)
    return table if table.num_rows <= MAX_BROADCAST_QUERIES and size <= MAX_BROADCAST_BYTES else None


def scan_with_broadcast(vectors: DataFrame, table: pa.Table, schema: str, kernel) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(vars(QueryBlock.of(table)))

    def run(batches):
        best, chunk_type = kernel(QueryBlock(**shared.value)), None
        for batch in batches:
            chunk_type = batch.schema.field("chunk_id").type
            if batch.num_rows:
                best.scan(batch)
        if chunk_type is not None:
            yield best.result(chunk_type)

    return vectors.mapInArrow(run, schema)


def grid(n: int, components: int, hits: int, vectors: int, tasks: int, id_bytes: int) -> tuple[int, int]:
    """Groups of ``n`` query rows and slabs of vectors, for ``tasks`` tiles at least.

    A group is no larger than a task can hold. More of them move the vectors more
    often, more slabs move queries and hits more often: about what moves least is taken.
    """
    least = max(-(-n // GROUP_ROWS), -(-components * 20 // MAX_BROADCAST_BYTES), -(-hits // GROUP_HITS), 1)
    vector = 2 * components // max(1, n)  # bytes, compressed
    per_slab, per_group = hits * (10 + id_bytes) + n * vector, max(1, vectors * (vector + id_bytes))
    groups = max(least, min(tasks, math.isqrt(int(tasks * per_slab / per_group))))
    return groups, max(1, -(-tasks // groups))


def scan_in_tiles(vectors: DataFrame, rows: DataFrame, schema: str, kernel) -> DataFrame:
    """Any number of query rows: groups of queries times slabs of vectors, each pair of them one partition.

    The vectors are read once and dealt to every group of queries, the queries to
    every slab. A partition holds its group and streams its slab, so memory
    follows the bounded group; there are as many slabs as keep all cores at
    work, and only the best of a slab go on.
    """
    n, components, hits = rows.agg(
        F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.coalesce(F.sum(F.least("k", F.lit(MOST_K)).cast("long")), F.lit(0))).first()
    session = rows.sparkSession
    cores = session.sparkContext.defaultParallelism
    if n <= MAX_BROADCAST_QUERIES and components * 20 <= MAX_BROADCAST_BYTES:
        groups, slabs = 1, max(3 * cores, int(session.conf.get("spark.sql.shuffle.partitions")))
    else:
        groups, slabs = grid(n, components, hits, vectors.count(), 4 * cores, 70 if dict(vectors.dtypes)["chunk_id"] == "string" else 8)
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))  # a query's rows stay together
    slab = F.pmod(F.xxhash64("chunk_id"), F.lit(slabs))
    asked = rows.withColumn("tile_", F.explode(F.sequence(group * slabs, group * slabs + slabs - 1))).withColumn("side_", F.lit(0))
    dealt = vectors.withColumn("tile_", F.explode(F.sequence(slab, slab + (groups - 1) * slabs, F.lit(slabs).cast("long")))).withColumn("side_", F.lit(1))
    both = asked.unionByName(dealt, allowMissingColumns=True)
    both = both.repartitionById(groups * slabs, F.col("tile_").cast("int")).sortWithinPartitions("tile_", "side_")
    sides = {0: [f.name for f in rows.schema], 1: [f.name for f in vectors.schema]}

    def run(batches):
        tile, waiting, best, chunk_type = None, [], None, None
        for batch in batches:
            chunk_type = batch.schema.field("chunk_id").type
            mark = 2 * batch["tile_"].to_numpy() + batch["side_"].to_numpy()
            cuts = np.flatnonzero(np.diff(mark, prepend=-1, append=-1)) if len(mark) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                here, side = divmod(int(mark[i]), 2)
                if here != tile:
                    if best is not None:
                        yield best.result(chunk_type)
                    tile, waiting, best = here, [], None
                piece = batch.slice(i, j - i).select(sides[side])
                if side == 0:
                    waiting.append(piece)
                elif waiting:
                    best = best or kernel(QueryBlock.of(pa.Table.from_batches(waiting)))
                    best.scan(piece)
        if best is not None:
            yield best.result(chunk_type)

    return both.mapInArrow(run, schema)


def scanned(wanted: DataFrame, rows: DataFrame, scope: str, kernel, columns=("embedding",)) -> DataFrame:
    """``query_id, chunk_id, scope, distance, k``: what ``kernel`` keeps of the index, part by part."""
    table = few(rows)
    if table is not None:
        named = set().union(*(columns_of(json.loads(w)) for w in set(table["where"].to_pylist()) if w is not None))
    else:
        rows = materialize(rows, "queries")
        asked = rows.where("where is not null").select("where").distinct().mapInArrow(filter_names, "name string")
        named = {r["name"] for r in asked.distinct().collect()}
    if missing := sorted(named - set(wanted.columns)):
        raise ValueError(f"the index has no column {missing[0]!r} to filter on")
    carried = [F.col(c).alias(CARRIED + c) for c in sorted(named)]
    vectors = wanted.select("chunk_id", F.col(scope).cast("string").alias("scope"), *columns, *carried)
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema, *vectors.schema]}
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, scope string, distance double, k int"
    if table is None:
        return scan_in_tiles(vectors, rows, schema, kernel)
    scopes = table["scopes"].combine_chunks()
    if scopes.null_count == 0:  # lets a partitioned index skip all other folders
        vectors = vectors.where(F.col("scope").isin(scopes.flatten().unique().to_pylist()))
    return scan_with_broadcast(vectors, table, schema, kernel)


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    where: dict | None = None,
    scope: str = "space",
    exclude_self: bool = False,
    per_scope: bool = False,
) -> DataFrame:
    """``query_id, chunk_id, scope, distance, rank``: the ``k`` nearest rows of ``index``.

    ``queries(query_id, embedding[, k, scopes, where])``; a query meets the rows
    whose ``scope`` column is among its ``scopes``, passing ``where`` (for all)
    and its own filter. Ranks are per query, or per query and scope.
    """
    rows = query_rows(queries, k, 1 if exclude_self else 0)
    found = scanned(metadata_filter(index, where), rows, scope, lambda block: BestSoFar(block, per_scope))
    if exclude_self:
        found = found.where("cast(query_id as string) <> cast(chunk_id as string)").withColumn("k", F.col("k") - 1)
    return ranked(found, ["query_id", "scope"] if per_scope else ["query_id"])


def ranked(found: DataFrame, by: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k")).drop("k")
