"""Periodic run detection on Re-Pair grammars.

A run is a stretch of words that repeats itself with a period: words a period
apart are identical, and no neighbouring word goes on so. A document's word ids
are compressed by Re-Pair: again and again the commonest pair of symbols becomes
a nonterminal. A run that is not inside one half of a symbol crosses the boundary
between its halves, so runs are looked for once at the boundary of each
nonterminal, and of each node of a balanced tree over what Re-Pair leaves; they
are then moved to every place where the derivation has that nonterminal, and
intervals of one period that overlap are merged.

Every ``PROBE`` words inside a run of the lengths asked for occur in the document
again; only the stretches where that holds, exactly the parts that a grammar can
shorten, are compressed. Longest common extensions are answered for all
boundaries of a chunk of documents at once, by ranks of 1, 2, 4, ... words. A
document needs nothing of any other, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd

#: A run is at least this long, and at least so many periods.
SHORTEST, PERIODS = 24, 3
#: Words of which each stretch inside a run occurs again: with 24 words and 3 periods up to 9 do.
PROBE = 9
#: Longest ranked stretch is 2 to this power; longer extensions are read in steps of it.
LEVELS = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def stretches(hashes: np.ndarray, row: np.ndarray, at: np.ndarray, probe: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word + 1 of the stretches of rows in which every ``probe`` words occur twice in their row."""
    if not len(at):
        return at, at
    key = wd.mix(wd.window_hashes(hashes, probe)[at] + wd.mix(row.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    kept, rows = at[twice], row[twice]
    if not len(kept):
        return kept, kept
    first = np.concatenate(([True], (np.diff(kept) > 1) | (np.diff(rows) > 0)))
    last = np.concatenate((first[1:], [True]))
    start, end = kept[first], kept[last] + probe
    long = end - start >= shortest
    return start[long], end[long]


class Extensions:
    """Longest common extensions between places of a sequence, to the right and to the left."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n, self.ranks = len(ids), [ids.astype(np.int64)]
        while len(self.ranks) <= LEVELS and 2 << (len(self.ranks) - 1) <= max(longest, PROBE):
            half = 1 << (len(self.ranks) - 1)
            old = self.ranks[-1]
            new = -1 - np.arange(self.n)  # what does not fit is like nothing else
            fits = self.n - 2 * half + 1
            if fits > 0:
                new[:fits] = np.unique(old[:fits] * (self.n + 1) + old[half : half + fits], return_inverse=True)[1]
            self.ranks.append(new)

    def right(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words, at most ``limit``, that the sequence has in common from ``a`` and from ``b`` on."""
        return self.walk(a, b, limit, 1)

    def left(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words, at most ``limit``, in common before ``a`` and before ``b``."""
        return self.walk(a, b, limit, -1)

    def walk(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        top = len(self.ranks) - 1
        for level in range(top, -1, -1):
            width, rank = 1 << level, self.ranks[level]
            going = np.arange(len(a))
            while len(going):
                going = going[got[going] + width <= limit[going]]
                shift = got[going] if way > 0 else -got[going] - width
                going = going[rank[a[going] + shift] == rank[b[going] + shift]]
                got[going] += width
                if level < top:  # one step of each width below the greatest is enough
                    break
        return got


class Grammar:
    """Re-Pair over the stretches [first, last) of ``ids``: ``rules`` (left, right, words, a place), ``axioms`` (symbol, place)."""

    def __init__(self, ids: list[int], spans: list[tuple[int, int]], symbols: int):
        self.symbols, self.rules, self.axioms = symbols, [], []
        base, top = spans[0][0], spans[-1][1]
        sym = ids[base:top]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        places: dict[tuple[int, int], set[int]] = {}
        for first, last in spans:
            after[last - base - 1], before[first - base] = -1, -1
            for i in range(first - base, last - base - 1):
                places.setdefault((sym[i], sym[i + 1]), set()).add(i)
        heap = [(-len(p), 2, min(p), pair) for pair, p in places.items() if len(p) > 1]
        heapq.heapify(heap)
        while heap:
            count, size, at, pair = heapq.heappop(heap)
            now = places.get(pair, ())
            if len(now) < 2:
                continue
            if len(now) != -count:  # of late some have gone
                heapq.heappush(heap, (-len(now), size, at, pair))
                continue
            del places[pair]
            left, right = pair
            new, touched, rule_at = symbols + len(self.rules), set(), -1
            for i in sorted(now):
                j = after[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue  # the one before it took this symbol
                rule_at = i if rule_at < 0 else rule_at
                h, k = before[i], after[j]
                if h >= 0 and (sym[h], left) != pair:
                    places.get((sym[h], left), set()).discard(h)
                if k >= 0 and (right, sym[k]) != pair:
                    places.get((right, sym[k]), set()).discard(j)
                sym[i], sym[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    places.setdefault((new, sym[k]), set()).add(i)
                    touched.add((new, sym[k]))
                if h >= 0:
                    places.setdefault((sym[h], new), set()).add(h)
                    touched.add((sym[h], new))
            self.rules.append((left, right, self.words(left) + self.words(right), base + rule_at))
            for other in touched:
                found = places.get(other, ())
                if len(found) > 1:
                    heapq.heappush(heap, (-len(found), self.words(other[0]) + self.words(other[1]), min(found), other))
        for first, _ in spans:
            i, row = first - base, []
            while i >= 0:
                row.append((sym[i], base + i))
                i = after[i]
            self.axioms.append(row)

    def words(self, symbol: int) -> int:
        return 1 if symbol < self.symbols else self.rules[symbol - self.symbols][2]

    def boundaries(self, shortest: int) -> list[tuple[int, int, int, int]]:
        """(first, boundary, last + 1, rule or -1) of all rules and tree nodes of ``shortest`` words or more."""
        found = [(at, at + self.words(left), at + size, x) for x, (left, _, size, at) in enumerate(self.rules) if size >= shortest]
        for row in self.axioms:
            ends = [at for _, at in row] + [row[-1][1] + self.words(row[-1][0])]
            nodes = [(0, len(row))]
            while nodes:
                lo, hi = nodes.pop()
                if hi - lo > 1 and ends[hi] - ends[lo] >= shortest:
                    middle = (lo + hi) // 2
                    found.append((ends[lo], ends[middle], ends[hi], -1))
                    nodes += [(lo, middle), (middle, hi)]
        return found

    def everywhere(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """All places at which the derivation has each of the ``wanted`` rules."""
        needed = set()
        for x, (left, right, _, _) in enumerate(self.rules):
            if x in wanted or left - self.symbols in needed or right - self.symbols in needed:
                needed.add(x)
        found: dict[int, list] = {x: [] for x in needed}
        for row in self.axioms:
            for symbol, at in row:
                if symbol - self.symbols in needed:
                    found[symbol - self.symbols].append(np.array([at]))
        places = {}
        for x in sorted(needed, reverse=True):
            left, right, _, _ = self.rules[x]
            places[x] = np.concatenate(found.pop(x) or [np.zeros(0, np.int64)])
            if left - self.symbols in needed:
                found[left - self.symbols].append(places[x])
            if right - self.symbols in needed:
                found[right - self.symbols].append(places[x] + self.words(left))
        return {x: places[x] for x in wanted}


def crossing(ext: Extensions, nodes: np.ndarray, shortest: int, periods: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs of ``nodes`` (first, boundary, last + 1) that hold words on both sides of it.

    A run of ``shortest`` words and ``periods`` periods has a whole period on one
    side, and agrees with itself a period on for 8 words right or left of the
    boundary: only such periods are tried.
    """
    eight = ext.ranks[3]
    which, near, far = [], [], []  # far is a period to the left of the boundary, or to the right

    def tried(node: int, b: int, others: np.ndarray) -> None:
        which.append(np.full(len(others), node))
        near.append(np.full(len(others), b))
        far.append(others)

    for node, (lo, b, hi) in enumerate(nodes.tolist()):
        if b + 8 <= hi:
            tried(node, b, lo + np.flatnonzero(eight[lo:b] == eight[b]))
            tried(node, b, b + 1 + np.flatnonzero(eight[b + 1 : hi - 7] == eight[b]))
        if b - 8 >= lo:
            tried(node, b, lo + 8 + np.flatnonzero(eight[lo : b - 8] == eight[b - 8]))
            tried(node, b, b + 1 + np.flatnonzero(eight[b - 7 : hi - 7] == eight[b - 8]))
    none = np.zeros(0, np.int64)
    which, near, far = (np.concatenate(x) if x else none for x in (which, near, far))
    lo, hi = nodes[which, 0], nodes[which, 2]
    low, high = np.minimum(near, far), np.maximum(near, far)
    period = high - low
    start = low - ext.left(low, high, low - lo)
    end = high + ext.right(low, high, hi - high)
    kept = (end - start >= np.maximum(shortest, periods * period)) & (start < near) & (end > near)
    which, start, end, period = which[kept], start[kept], end[kept], period[kept]
    # of one interval the smallest period
    order = np.lexsort((period, end, start, which))
    which, start, end, period = which[order], start[order], end[order], period[order]
    first = np.ones(len(which), bool)
    first[1:] = (np.diff(which) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)
    return which[first], start[first], end[first], period[first]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal (start, end, period) in order: intervals of one period that share a period's words are one."""
    found, best = [], {}
    order = np.lexsort((end, start, period))
    for s, e, q in zip(start[order].tolist(), end[order].tolist(), period[order].tolist()):
        if found and found[-1][2] == q and s + q <= found[-1][1]:
            found[-1][1] = max(found[-1][1], e)
        else:
            found.append([s, e, q])
    for s, e, q in found:
        best[s, e] = min(q, best.get((s, e), q))
    return sorted((s, e, q) for (s, e), q in best.items())


def runs_of_rows(hashes: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> dict[int, list[tuple[int, int, int]]]:
    """(start, end, period) of the runs of each row that has any; ``bounds`` are the rows' first words."""
    probe = min(PROBE, shortest - 2 * (shortest // periods) + 1)
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row_of[: max(0, len(hashes) - probe + 1)] == row_of[probe - 1 :])
    start, end = stretches(hashes, row_of[at], at, probe, shortest)
    if not len(start):
        return {}
    size = end - start
    shift = start - (np.cumsum(size) - size)  # of the joined stretches to the chunk
    joined = np.repeat(shift, size) + np.arange(size.sum())
    vocabulary, ids = np.unique(hashes[joined], return_inverse=True)
    ext, listed = Extensions(ids, int(size.max())), ids.tolist()
    opens, rows = np.cumsum(size) - size, row_of[start]
    grammars, nodes, owner = [], [], []
    cuts = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        g = Grammar(listed, [(int(opens[i]), int(opens[i] + size[i])) for i in range(a, b)], len(vocabulary))
        mine = g.boundaries(shortest)
        nodes += [n[:3] for n in mine]
        owner += [(len(grammars), n[3]) for n in mine]
        grammars.append((int(rows[a]), g))
    if not nodes:
        return {}
    places = np.array(nodes, np.int64)
    which, start, end, period = crossing(ext, places, shortest, periods)
    found: dict[int, list] = {}
    for i, s, e, q in zip(which.tolist(), start.tolist(), end.tolist(), period.tolist()):
        found.setdefault(owner[i][0], []).append((owner[i][1], int(places[i, 0]), s, e, q))
    result = {}
    for g, mine in found.items():
        row, grammar = grammars[g]
        occurs = grammar.everywhere({x for x, *_ in mine if x >= 0})
        moved = []
        for x, first, s, e, q in mine:
            by = occurs[x] - first if x >= 0 else np.zeros(1, np.int64)
            moved.append(np.stack((s + by, e + by, np.full(len(by), q))))
        s, e, q = np.concatenate(moved, 1)
        stretch = np.searchsorted(opens, s, "right") - 1  # back to places of the row
        back = shift[stretch] - bounds[row]
        result[row] = merged(s + back, e + back, q)
    return result


def scan(shortest: int, periods: int, reorder: Callable[[object, int], np.ndarray | None] | None):
    """(key, id, text) to (key, number of words, runs, the text with runs collapsed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for w in wd.words(batch.column(2)):
                hashes, size, moved = wd.word_hashes(w), np.diff(w.bounds), {}
                if reorder is not None:
                    for r, key in enumerate(batch.column(1).slice(w.first, w.rows).to_pylist()):
                        index = reorder(key, int(size[r])) if size[r] else None
                        if index is not None:
                            moved[r] = index
                            hashes[w.bounds[r] : w.bounds[r + 1]] = hashes[w.bounds[r] + index]
                found = runs_of_rows(hashes, w.bounds, shortest, periods)
                left = []
                for r in range(w.rows):
                    pieces = (texts[w.first + r].as_py() or b"").split()
                    if r in moved:
                        pieces = [pieces[i] for i in moved[r].tolist()]
                    if r in found:
                        gone = np.zeros(len(pieces) + 1, np.int64)
                        for s, e, q in found[r]:
                            gone[s + q] += 1
                            gone[e] -= 1
                        pieces = [pieces[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                    left.append(b" ".join(pieces))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.first, w.rows), pa.array(size, pa.int64()),
                    pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in found.get(r, ())] for r in range(w.rows)], kind),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ], ["_key", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, periods: int = PERIODS, keep: tuple[str, ...] = ("doc_id",),
                  reorder: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (doc_id, text, ...) and n_words, runs, collapsed, for every row.

    Words are runs of bytes other than blank, tab and line controls. ``runs``
    lists (start, length, period) by start and period: the longest stretches of
    at least ``shortest`` words and ``periods`` times their smallest period in
    which words a period apart are equal. ``collapsed`` is the text, words joined
    by one blank, without the words that a run holds after its first period.
    ``reorder(doc_id, number of words)`` may give the word numbers to look at
    instead of 0, 1, 2, ..., or None. Null, empty and blank texts have no words
    and no runs; each row, repeated ones and those without an id too, is judged
    by itself; long texts are read whole; an empty table gives no rows. Words are
    compared by 64-bit hashes. Other columns are ignored.
    """
    if shortest < 24 or periods < 3:
        raise ValueError("runs of 24 words and 3 periods at least")
    key = F.struct(*[F.col(c) for c in keep]).alias("_key")
    source = docs.select(key, F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    return source.mapInArrow(scan(shortest, periods, reorder), schema).select("_key.*", "n_words", "runs", "collapsed")


def foremost(runs: Column) -> Column:
    """The run of the greatest length by period, the first of equal ones; null without runs. Compared without rounding."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
