"""Benchmark decontamination with suffix arrays over the training text.

The corpus is cut into shards of whole documents, one per chunk of an Arrow
batch. Each task builds the suffix array of its shard over words, and every
suffix of every benchmark item is looked up in it by binary search. What the
search gives is a range of the suffix array: all places that go on like the
suffix. Nothing but one row per document leaves a shard, so nothing is
shuffled, no shard is larger than a chunk or one document, and a lost task is
repeated on its own.

The benchmark is a query set and goes to the tasks in blocks of bounded size,
one pass over the corpus each; its length is never assumed to be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.session import materialize

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Words of benchmark items in one block; about 16 bytes each go to every task.
BLOCK_WORDS = 1 << 20

SPANS = "row_id long, n_words long, spans array<struct<first:int,last:int>>, item_ids array<string>, longest array<struct<item:string,at:int,words:int>>"


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, vocabulary, ids): suffixes in order of their first ``depth`` words or more.

    Words are compared by the order of their ids; prefix doubling sorts by 1, 2,
    4, ... words until ``depth`` is reached or all suffixes differ.
    """
    vocabulary, ids = np.unique(tokens, return_inverse=True)
    n, rank, width = len(ids), ids.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while width < depth and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after  # both are at most n, so the key fits
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([True], np.diff(key[order]) > 0)))
        rank, width = new, 2 * width
        if rank[order[-1]] == n:
            break
    return order, vocabulary, ids


def lookup(text: np.ndarray, order: np.ndarray, suffixes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of ``order`` whose suffixes of ``text`` begin with ``suffixes[i, :length[i]]`` (ids; below 0: unknown word)."""
    n = len(order)
    found = []
    for right in (False, True):
        low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), n, np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, n - 1)]
            smaller, equal = np.zeros(len(suffixes), bool), np.ones(len(suffixes), bool)
            for j in range(suffixes.shape[1]):
                going = equal & (j < length)
                if not going.any():
                    break
                here = np.where(at + j < n, text[np.minimum(at + j, n - 1)], -1)
                smaller |= going & (here < suffixes[:, j])
                equal &= ~going | (here == suffixes[:, j])
            go_right = smaller | (equal if right else False)
            low = np.where(open_ & go_right, middle + 1, low)
            high = np.where(open_ & ~go_right, middle, high)
        found.append(low)
    return found[0], found[1]


def extend(text: np.ndarray, at: np.ndarray, item: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words ``text[at:]`` and ``item[start:limit]`` have in common."""
    length = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        t, s = at[open_] + length[open_], start[open_] + length[open_]
        same = (t < len(text)) & (s < limit[open_])
        same[same] = text[t[same]] == item[s[same]]
        open_ = open_[same]
        length[open_] += 1
    return length


class Suffixes:
    """Suffixes of a block of items: every 13-word window, and for each item its whole words to extend into."""

    def __init__(self, names: list[str | None], hashes: list[np.ndarray], window: int):
        known = set(names)  # texts of one id are one item
        self.names, self.window = sorted(known - {None}) + [None] * (None in known), window
        place = {name: i for i, name in enumerate(self.names)}
        self.flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        bounds = np.cumsum([0, *map(len, hashes)])
        counts = [max(1, len(h) - window + 1) if len(h) else 0 for h in hashes]
        text = np.repeat(np.arange(len(hashes)), counts)
        self.item = np.array([place[name] for name in names], np.int64)[text]
        self.start = np.concatenate([bounds[i] + np.arange(c) for i, c in enumerate(counts)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.end = bounds[1:][text] if len(text) else np.zeros(0, np.int64)
        self.length = np.minimum(window, self.end - self.start)


def search_shard(tokens: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, suffix, window words, longest match from there) of all occurrences of windows in a shard."""
    none = np.zeros(0, np.int64)
    if not len(tokens) or not len(s.start):
        return none, none, none, none
    order, vocabulary, ids = suffix_array(tokens, s.window)
    place = np.minimum(np.searchsorted(vocabulary, s.flat), len(vocabulary) - 1)
    known = np.where(vocabulary[place] == s.flat, place, -1)
    wide = s.start[:, None] + np.arange(s.window)
    inside = np.arange(s.window) < s.length[:, None]
    matrix = np.where(inside, known[np.minimum(wide, len(known) - 1)], -1)
    able = np.flatnonzero(~((matrix < 0) & inside).any(1))  # a suffix with an unknown word has no place
    if not len(able):
        return none, none, none, none
    low, high = lookup(ids, order, matrix[able], s.length[able])
    many = high - low
    suffix = np.repeat(able, many)
    at = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    return at, suffix, s.length[suffix], extend(tokens, at, s.flat, s.start[suffix], s.end[suffix])


def scan(s: Suffixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wd.words(batch.column(1), wd.ALNUM, lower=True):
                ids = batch.column(0).slice(w.first, w.rows)
                # a mark between documents, so that no match runs over a border
                hashes = wd.word_hashes(w) | np.uint64(1)
                gaps = np.arange(len(hashes)) + w.row
                tokens = np.zeros(len(hashes) + w.rows, np.uint64)
                tokens[gaps] = hashes
                marks = w.bounds[1:] + np.arange(w.rows)
                tokens[marks] = np.uint64(2) * np.arange(w.rows, dtype=np.uint64)
                at, suffix, length, longest = search_shard(tokens, s)
                row = np.searchsorted(marks, at, "right")
                first = at - (w.bounds[:-1] + np.arange(w.rows))[row] if len(at) else at
                size = np.diff(w.bounds)
                out = [[] for _ in range(3)]
                groups = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[groups], np.arange(w.rows + 1))
                for r in range(w.rows):
                    mine = groups[cuts[r] : cuts[r + 1]]
                    if not len(mine):
                        for o in out:
                            o.append([])
                        continue
                    hit = np.zeros(size[r] + 1, np.int64)
                    np.add.at(hit, first[mine], 1)
                    np.add.at(hit, np.minimum(first[mine] + length[mine], size[r]), -1)
                    on = np.diff(np.concatenate(([0], (np.cumsum(hit) > 0).astype(np.int8), [0])))
                    out[0].append([{"first": int(a), "last": int(b)} for a, b in zip(np.flatnonzero(on > 0), np.flatnonzero(on < 0))])
                    items = s.item[suffix[mine]]
                    out[1].append([s.names[i] for i in np.unique(items)])
                    best = []
                    for i in np.unique(items):
                        k = mine[items == i]
                        k = k[np.lexsort((first[k], -longest[k]))[0]]
                        best.append({"item": s.names[i], "at": int(first[k]), "words": int(longest[k])})
                    out[2].append(best)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(size, pa.int64()),
                    pa.array(out[0], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array(out[1], pa.list_(pa.string())),
                    pa.array(out[2], pa.list_(pa.struct([("item", pa.string()), ("at", pa.int32()), ("words", pa.int32())]))),
                ], ["row_id", "n_words", "spans", "item_ids", "longest"])

    return run


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Suffixes]:
    """Blocks of distinct item texts with their ids, read from Spark one partition at a time."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    names, hashes, total = [], [], 0
    for row in texts.where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        for w in wd.words(pa.array([row.text]), wd.ALNUM, lower=True):
            h = wd.word_hashes(w) | np.uint64(1)
            if len(h):
                names.append(row.item_id)
                hashes.append(h)
                total += len(h)
        if total >= block_words:
            yield Suffixes(names, hashes, window)
            names, hashes, total = [], [], 0
    if names:
        yield Suffixes(names, hashes, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN,
                  block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, ...) and n_words, n_hit, n_items, item_ids, longest, contaminated, per row.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A
    window is ``window`` consecutive words of an item (text, item_id); a shorter
    item with words is one window. A word inside any occurrence is hit; a
    document is contaminated if ``one_in`` times its hit words reach its words.
    ``longest`` gives for each item its longest verbatim match from a window on.
    Null or empty texts have no words and are clean; items without words match
    nothing; repeated items count once by id, those without an id as one item,
    null in ``item_ids``; repeated rows give repeated rows; an empty benchmark
    leaves all clean. Other columns are ignored.
    """
    source = docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.col("text").cast("string").alias("_text"))
    blocks = item_blocks(benchmark, window, block_words)
    first, second = next(blocks, Suffixes([], [], window)), next(blocks, None)
    if second is None:
        keyed = source.select(F.struct(*[f"_k_{c}" for c in keep]).alias("_key"), "_text")
        schema = SPANS.replace("row_id long", "row_id " + keyed.schema["_key"].dataType.simpleString())
        found = keyed.mapInArrow(scan(first), schema).select("row_id.*", "n_words", "spans", "item_ids", "longest")
    else:
        # several passes: rows need a name that all passes agree on, and their spans are joined
        named = materialize(source.withColumn("_row", F.monotonically_increasing_id()), "named")
        merged = None
        while first is not None:
            part = materialize(named.select("_row", "_text").mapInArrow(scan(first), SPANS).where("size(spans) > 0"), "spans")
            merged = part if merged is None else merged.unionByName(part)
            first, second = second, next(blocks, None)
        sizes = named.select("_row", "_text").mapInArrow(scan(Suffixes([], [], window)), SPANS).select("row_id", "n_words")
        joined = merged.groupBy("row_id").agg(*[
            F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "item_ids", "longest")])
        # one match for each item, however many blocks its texts lie in: the longest, of equal ones the first
        best = F.transform(F.array_sort("item_ids"), lambda i: F.array_max(F.transform(
            F.filter("longest", lambda m: m.item.eqNullSafe(i)), lambda m: F.struct(m.words.alias("words"), (-m["at"]).alias("back"), m.alias("match"))))["match"])
        joined = joined.withColumn("longest", best)
        sizes = materialize(sizes.join(joined, "row_id", "left"), "merged")
        found = named.drop("_text").join(sizes.withColumnRenamed("row_id", "_row"), "_row")
        for c in ("spans", "item_ids", "longest"):
            found = found.withColumn(c, F.coalesce(c, F.array().cast(found.schema[c].dataType)))
    # the union of spans: in order of their first words, each adds what lies past the furthest end so far
    walked = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc.hit + F.greatest(F.lit(0), x["last"] - F.greatest(acc.to, x["first"]))).alias("hit"),
            F.greatest(acc.to, x["last"]).alias("to")))
    n_hit = walked.hit.cast("long")
    return found.select(
        *[F.col(f"_k_{c}").alias(c) for c in keep], "n_words", n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"), F.array_sort("item_ids").alias("item_ids"), "longest",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged; options of ``contamination``."""
    whole = F.struct(*docs.columns).alias("_row")  # so that columns of docs may have any name
    found = contamination(docs.select(whole, F.col("text").alias("text")), benchmark, keep=("_row",), **options)
    return found.where("not contaminated").select("_row.*")
