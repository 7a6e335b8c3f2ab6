"""Ranked lexical search over document FP-trees.

Documents become vectors of their counts of the query terms. Those of a shard,
a bounded number of documents of one task, are put in order of their terms, the
most frequent term of the corpus first, so that documents which begin alike
share a path of a trie; a node is a range of documents. Every node has the
greatest count of each term and the least length weight below it, and the score
made of these bounds what any document below can reach. For each item the tree
is searched depth first, best child first, and a branch whose bound is less than
the item's k-th score so far is left out. The best so far go on from shard to
shard of a task; only they are shuffled.

The items are a query set and go to the tasks in blocks of a bounded number of
terms, one pass over the corpus each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.session import materialize

TOP = 50
#: Different terms, and items, of one block; its items go to every task.
BLOCK_TERMS, BLOCK_ITEMS = 8192, 2048
#: Documents of a shard, and counts that its table may hold; documents of a leaf.
SHARD, CELLS, LEAF = 4096, 1 << 24, 64
NONE = np.zeros(0, np.int64)


class Item(NamedTuple):
    number: int  # of the row, over all blocks
    terms: np.ndarray  # hashes, later places in the order of the terms
    weights: np.ndarray  # whole numbers


def term_hashes(text: str) -> np.ndarray:
    found = [wd.word_hashes(w) for w in wd.words(pa.array([text], pa.string()), wd.ALNUM, lower=True)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def item_blocks(items: DataFrame, block_terms: int, block_items: int) -> Iterator[tuple[list[tuple[int, np.ndarray]], np.ndarray]]:
    """([(row number, its terms)], all terms) for blocks of stored ``items`` (_n, text), read one partition at a time."""
    block, terms = [], np.zeros(0, np.uint64)
    for row in items.where("text is not null").select("_n", "text").toLocalIterator():
        mine = term_hashes(row.text)
        if len(mine):
            both = np.union1d(terms, mine)
            if block and (len(both) > block_terms or len(block) >= block_items):
                yield block, terms
                block, both = [], mine
            block.append((row[0], mine))
            terms = both
    if block:
        yield block, terms


def counts(terms: np.ndarray):
    """(doc_id, text) to (doc_id, all its terms, which of ``terms`` it has, how often); texts without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wd.words(batch.column(1), wd.ALNUM, lower=True):
                hashes = wd.word_hashes(w)
                place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                known = terms[place] == hashes
                key, tf = np.unique(w.row[known] * len(terms) + place[known], return_counts=True)
                row, term = key // len(terms), key % len(terms)
                size = np.diff(w.bounds)
                full = np.flatnonzero(size)
                cuts = np.append(np.searchsorted(row, full), len(row)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.first, w.rows).take(pa.array(full)), pa.array(size[full], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(tf)),
                ], ["doc_id", "n", "terms", "tfs"])

    return run


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Tree:
    """The FP-tree of a shard: documents in order of their paths, nodes as ranges of them.

    ``child`` and ``children`` give the first child and the number of children,
    which are numbered one after the other; leaves have none.
    """

    def __init__(self, flat: np.ndarray, tfs: np.ndarray, bounds: np.ndarray, m: np.ndarray, terms: int, leaf: int):
        rows = len(bounds) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))
        order = np.lexsort((flat, row))
        flat, tfs = flat[order], tfs[order]
        wide = flat.astype(">u4").tobytes()  # compares as the numbers do
        path = [wide[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        self.order = np.array(sorted(range(rows), key=path.__getitem__), np.int64)
        place = np.empty(rows, np.int64)
        place[self.order] = np.arange(rows)
        self.m = m[self.order]
        tf = np.zeros((rows, terms), np.int32 if not len(tfs) or tfs.max() < 1 << 31 else np.int64)
        tf[place[row], flat] = tfs
        size, begin = np.diff(bounds)[self.order], bounds[:-1][self.order]
        self.low, self.high, self.child, self.children = [0], [rows], [-1], [0]
        at = 0
        depth = [0]
        while at < len(self.low):
            lo, hi, d = self.low[at], self.high[at], depth[at]
            while hi - lo > leaf:
                here = np.where(size[lo:hi] > d, flat[np.minimum(begin[lo:hi] + d, max(0, len(flat) - 1))], -1)
                cuts = np.flatnonzero(np.diff(here)) + 1
                d += 1
                if len(cuts):
                    ends = [*cuts.tolist(), hi - lo]
                    self.child[at], first = len(self.low), 0
                    for i, end in enumerate(ends):  # small neighbours share a leaf
                        if i + 1 == len(ends) or end - first >= leaf or ends[i + 1] - end > leaf:
                            self.low.append(lo + first)
                            self.high.append(lo + end)
                            self.child.append(-1)
                            self.children.append(0)
                            # several paths in one node part at this depth again
                            depth.append(d if here[first] == here[end - 1] else d - 1)
                            first = end
                    self.children[at] = len(self.low) - self.child[at]
                    if self.children[at] == 1:  # all in one: a leaf after all
                        for x in (self.low, self.high, self.child, self.children, depth):
                            x.pop()
                        self.child[at], self.children[at] = -1, 0
                    break
                if here[0] < 0:
                    break  # all end here: one vector
            at += 1
        n = len(self.low)
        self.most, self.least = np.zeros((n, terms), tf.dtype), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            if self.children[i]:
                own = slice(self.child[i], self.child[i] + self.children[i])
                self.most[i], self.least[i] = self.most[own].max(0), self.least[own].min()
            else:
                own = slice(self.low[i], self.high[i])
                self.most[i], self.least[i] = tf[own].max(0), self.m[own].min()
        # what a term of weight 1 gives each document, and at most below each node; all below a million
        tf[place[row], flat] = saturated(tfs, m[row])
        self.gives, self.bound = tf, np.zeros((n, terms), np.int32)
        node, term = np.nonzero(self.most)
        self.bound[node, term] = saturated(self.most[node, term].astype(np.int64), self.least[node])

    def score(self, table: np.ndarray, own: slice, item: Item) -> np.ndarray:
        return table[own].take(item.terms, axis=1).astype(np.float64) @ item.weights  # whole numbers far below 2^53

    def search(self, item: Item, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids) and what this tree has to add: depth first, without branches that cannot add."""
        scores, docs = best
        least = scores.min() if len(scores) >= top else 1
        open_ = [(int(self.score(self.bound, slice(0, 1), item)[0]), 0)]
        while open_:
            bound, node = open_.pop()
            if bound < least:
                continue
            if self.children[node]:
                first = self.child[node]
                bounds = self.score(self.bound, slice(first, first + self.children[node]), item)
                kept = (bounds >= least).nonzero()[0]
                kept = kept[np.argsort(bounds[kept], kind="stable")]
                open_ += zip(bounds[kept].tolist(), (first + kept).tolist())
                continue
            own = slice(self.low[node], self.high[node])
            found = self.score(self.gives, own, item)
            kept = (found >= least).nonzero()[0]
            if len(kept):
                scores = np.concatenate((scores, found[kept].astype(np.int64)))
                docs = np.concatenate((docs, ids[self.order[own][kept]]))
                if len(scores) >= top:
                    first = np.lexsort((docs, -scores))[:top]
                    scores, docs = scores[first], docs[first]
                    least = scores[-1]
        return scores, docs


def search(items: list[Item], place: np.ndarray, total: int, length: int, top: int, shard: int, leaf: int):
    """(doc_id, n, terms, tfs) of a task to (item, doc_id, score): the ``top`` best of each item; ``place`` orders the terms."""
    last = np.iinfo(np.int64).max  # a null id comes after all others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(NONE, NONE) for _ in items]

        def look(parts: list[tuple[np.ndarray, ...]]) -> None:
            ids, n, sizes, flat, tfs = (np.concatenate(x) for x in zip(*parts))
            m = 50 + (50 * n * total) // length
            tree = Tree(flat, tfs, np.concatenate(([0], np.cumsum(sizes))), m, len(place), leaf)
            for i, item in enumerate(items):
                best[i] = tree.search(item, ids, best[i], top)

        waiting, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                part = batch.slice(at, shard)
                lists = part.column(2)
                waiting.append((
                    part.column(0).fill_null(last).to_numpy(), part.column(1).to_numpy(),
                    lists.value_lengths().to_numpy().astype(np.int64), place[lists.flatten().to_numpy()], part.column(3).flatten().to_numpy()))
                rows += part.num_rows
                if rows >= shard:
                    look(waiting)
                    waiting, rows = [], 0
        if waiting:
            look(waiting)
        sizes = [len(s) for s, _ in best]
        docs = np.concatenate([d for _, d in best]) if best else NONE
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([i.number for i in items], np.int64), sizes)), pa.array(docs, mask=docs == last),
            pa.array(np.concatenate([s for s, _ in best]) if best else NONE)], ["_n", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS,
           shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Terms are runs of letters, digits and non-ASCII characters, A-Z lowered, of
    whole texts. A term that ``df`` of the N documents with terms hold weighs
    floor(1000 ln((2N + 2) / (2 df + 1))). A document of n terms, L being those of
    all, has m = 50 + 50 n N div L, and scores for an item the sum over its terms,
    once each, of weight * (10^9 tf div (1000 tf + 20 m)). Documents that score 0
    are left out; equal scores go by doc_id (a whole number), null last. Null,
    empty and blank texts have no terms; an item without terms, or an empty
    table, has no rows; repeated rows of either table each count. Terms are
    compared by 64-bit hashes. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = materialize(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("_n", F.monotonically_increasing_id()), "items")
    best = None
    for block, terms in item_blocks(named, block_terms, block_items):
        vectors = materialize(source.mapInArrow(counts(terms), "doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")
        total, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        df = np.zeros(len(terms), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
            df[term] = n
        # the most frequent term first
        order = np.argsort(-df, kind="stable")
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        weight = np.array([floor(1000 * log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        asked = []
        for number, mine in block:
            own = np.searchsorted(terms, mine)
            own = own[(df[own] > 0) & (weight[own] > 0)]
            asked.append(Item(number, place[own], weight[own].astype(np.float64)))
        held = max(64, min(shard, CELLS // len(terms)))
        found = vectors.where("size(terms) > 0").mapInArrow(
            search(asked, place, total, length, top, held, leaf), "_n long, doc_id long, score long")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = named.select("_n", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    window = Window.partitionBy("_n").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = materialize(best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top), "best")
    return named.select("_n", "item_id").join(placed, "_n").select("item_id", "rank", "doc_id", "score")
