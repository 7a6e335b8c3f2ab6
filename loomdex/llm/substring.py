"""Substring deduplication with fixed-block anchors.

Every text is cut into non-overlapping reference blocks, half a window long, so
that a window of ``window`` words holds a whole block wherever it begins. The
blocks are indexed by hash with their least and greatest place. Every rolling
window of a block's length probes the index; a probe that meets a block of
another place is an anchor. Only texts with anchors are read again: around
anchors the repeats are extended to windows of full length, and those windows
are matched by 96-bit hashes over all texts. Matching windows that overlap
are together the maximal exact repeats, and every word in one is removed.

No pair of places is ever written out: a passage that a third of all documents
share gives one row a place, joined to one row of the index. Both joins have
stored tables on the small side, so hot hashes can be split. Probes, the widest
step, are made and joined in rounds, a part of the hashes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.llm.stored import stored

WINDOW = 35
#: A probe is one long: the upper 44 bits of its hash, then its place, of which the last value stands for all later ones.
PLACE_BITS = 20
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Probes are joined in so many rounds over parts of the hashes (at most 8), so that they never lie on disk together.
ROUNDS = 3
PART_BITS = 3


def digest(pieces: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(pieces)).hexdigest()


def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, number of words, hash of all words)."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        pieces = [t.as_py().split() if t.is_valid else [] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p) for p in pieces], pa.int64()), pa.array([digest(p) for p in pieces])],
            ["_key", "n_words", "sha"])


def places(k: int, window: int, blocks_only: bool, part: int = 0, parts: int = 1):
    """(text id, text) to (text id, hash and place) of rolling windows of ``k`` words, or of the blocks only; of one part of the hashes.

    Anchors only say where to look, so a shortened hash is enough: a chance
    match costs a look and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in wd.words(batch.column(1)):
                rolled = wd.window_hashes(wd.word_hashes(w), k)
                at, row = wd.row_windows(w, k)
                place = at - w.bounds[row]
                mine = ids[w.first : w.first + w.rows]
                # a text that a chunk holds more than once gives its rows once
                _, once = np.unique(mine, return_index=True)
                only = np.zeros(w.rows, bool)
                only[once] = True
                kept = only[row] & (np.diff(w.bounds)[row] >= window)
                if blocks_only:
                    kept &= place % k == 0
                if parts > 1:
                    kept &= (rolled[at] >> np.uint64(64 - PART_BITS)) % np.uint64(parts) == part
                high = rolled[at[kept]] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
                packed = high | np.minimum(place[kept], LAST_PLACE).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[row[kept]]), pa.array(packed.view(np.int64))], ["text_id", "probe"])

    return run


def wide_windows(window: int, k: int):
    """(text id, text, anchors) to 96-bit hashes and places of full windows that hold a whole anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column(2)
            flat, bounds = anchors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(anchors.value_lengths().to_numpy())))
            ids = batch.column(0).to_numpy()
            for w in wd.words(batch.column(1)):
                at, row = wd.row_windows(w, window)
                # anchors begin in [start, start + window - k]
                anchor = np.zeros(len(w.start) + 1, np.int64)
                mine = np.arange(bounds[w.first], bounds[w.first + w.rows])
                owner = np.repeat(np.arange(w.rows), np.diff(bounds[w.first : w.first + w.rows + 1]))
                anchor[w.bounds[owner] + flat[mine]] = 1
                for r in owner[flat[mine] == LAST_PLACE]:
                    anchor[w.bounds[r] + LAST_PLACE : w.bounds[r + 1]] = 1
                sums = np.concatenate(([0], np.cumsum(anchor)))
                kept = sums[np.minimum(at + window - k + 1, len(sums) - 1)] > sums[at]
                at, row = at[kept], row[kept]
                one = wd.window_hashes(wd.word_hashes(w), window)[at]
                two = wd.window_hashes(wd.word_hashes(w, seed=2), window, seed=2)[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[w.first : w.first + w.rows][row]), pa.array(one.view(np.int64)),
                    pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array((at - w.bounds[row]).astype(np.int32))], ["text_id", "one", "two", "place"])

    return run


def cut(window: int):
    """(text id, text, places) to what is left once the windows at ``places`` are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, at in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                pieces = text.as_py().split()
                gone = wd.covered(np.asarray(at.values.to_numpy(), np.int64), window, len(pieces))
                removed.append(int(gone.sum()))
                kept.append(digest([pieces[i] for i in np.flatnonzero(~gone)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["text_id", "removed", "sha_left"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, windows): a row per document, the texts with anchors, and their repeated windows.

    ``rows`` has the columns of ``_key``, n_words, sha, text_id and the number of
    documents with the same text; ``windows`` holds text_id and the places, from
    0, at which a repeated window begins.
    """
    k = (window + 1) // 2
    text = F.col("text").cast("string")
    source = docs.select(F.struct("doc_id", F.xxhash64(text).alias("text_id")).alias("_key"), text.alias("text"))
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, n_words long, sha string"
    rows = stored(source.mapInArrow(summary, schema).select("_key.*", "n_words", "sha"), "rows")
    same = rows.groupBy("text_id").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("rep"))
    same = stored(same, "same")

    pair = source.select("_key.text_id", "text")
    fields = "text_id long, probe long"
    hashed, spot = F.shiftright("probe", PLACE_BITS), F.xxhash64("text_id", "probe")
    blocks = pair.mapInArrow(places(k, window, True), fields)
    index = stored(blocks.groupBy(hashed.alias("hash")).agg(F.min(spot).alias("least"), F.max(spot).alias("most")), "index")
    place = F.col("probe").bitwiseAND(LAST_PLACE).cast("int")
    elsewhere = (spot != F.col("least")) | (spot != F.col("most")) | (place == LAST_PLACE)
    upper = F.shiftright("hash", 64 - PLACE_BITS - PART_BITS).bitwiseAND((1 << PART_BITS) - 1)
    met = None
    for part in range(ROUNDS):
        probes = pair.mapInArrow(places(k, window, False, part, ROUNDS), fields)
        mine = index.where(upper % ROUNDS == part).hint("shuffle_hash")
        hits = probes.join(mine, F.shiftright(probes["probe"], PLACE_BITS) == mine["hash"]).where(elsewhere)
        hits = stored(hits.groupBy("text_id").agg(F.collect_set(place).alias("anchors")), "hits")
        met = hits if met is None else met.union(hits)
    anchors = met.groupBy("text_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    anchors = stored(anchors.join(same, "text_id").select("text_id", "rep.doc_id", "anchors"), "anchors")

    read = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_id"), text.alias("text"))
    texts = read.join(anchors.hint("shuffle_hash"), read["_doc"].eqNullSafe(anchors["doc_id"]) & (read["_id"] == anchors["text_id"]))
    texts = stored(texts.dropDuplicates(["text_id"]).select("text_id", "text", "anchors"), "texts")

    wide = texts.mapInArrow(wide_windows(window, k), "text_id long, one long, two int, place int")
    twice = stored(wide.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"), "twice")
    found = wide.join(twice, ["one", "two"]).groupBy("text_id").agg(F.collect_set("place").alias("places"))
    found = stored(found, "found")
    return rows.join(same.select("text_id", "copies"), "text_id"), texts.select("text_id", "text"), found


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text).

    Words are runs without blanks, tabs and line controls. Every word covered by
    ``window`` consecutive words that also begin anywhere else, in any row or at
    another place of the same one, is removed; windows are judged on the input.
    ``kept_sha256`` is the hash of the words left, joined by one space. Null,
    empty and shorter texts keep all; rows with equal texts, equal rows too, are
    each other's repeats; null doc_ids are rows as all others. Equal windows are
    found by 96-bit hashes. Other columns are ignored.
    """
    rows, texts, found = repeats(docs, window)
    left = texts.join(found, "text_id").mapInArrow(cut(window), "text_id long, removed long, sha_left string")
    left = stored(left, "left")
    joined = rows.join(left, "text_id", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return joined.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(digest([]))).otherwise(F.coalesce("sha_left", "sha")).alias("kept_sha256"))
