"""Packing of tokenised documents into sequences of one length.

Documents become token ids once; what fills whole sequences is cut off at once,
and the rests are dealt at random into groups of a bounded number of tokens.
Each group is packed on its own by first fit decreasing: a tournament tree over
the room left in each sequence finds the first that has enough. What first fit
leaves open is then filled by cutting up the emptiest sequences, and the last
rest of a group is cut into powers of two, which need no padding either.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.session import materialize

LENGTH = 4096
#: The id behind each document.
END = 2
#: Tokens, and pieces, of a group on average.
GROUP_TOKENS, GROUP_PIECES = 1 << 21, 1 << 15
#: Distinct units of text whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 2_000_000

PIECE = "doc_id {id}, doc_tokens long, start long, length long, crc long, ids binary"


# Bytes of units: letters (ASCII, and the letters whose first byte is C3), digits, other marks; what a unit must not hold.
LETTER, DIGIT, MARK = 1, 2, 3
KIND = np.full(256, MARK, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = LETTER
KIND[0x30:0x3A] = DIGIT
ODD = np.zeros(256, bool)
ODD[[*range(0x20), 0x27, 0x7C, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
ODD[[0x20, *range(0x09, 0x0E)]] = False


def units(w: wd.Words) -> wd.Words:
    """Words cut into lower-case runs of letters, single digits and runs of other marks.

    A word with an apostrophe, a bar, a control character or a character beyond
    the letters of Latin-1 stays as it is: the tokenizer sees it whole.
    """
    if not len(w.start):
        return w
    data, after = w.data, np.zeros(len(w.data), bool)
    after[1:] = data[:-1] == 0xC3
    odd = ODD[data] | (after & ((data == 0x97) | (data == 0xB7)))
    opens = np.zeros(len(data), bool)
    opens[w.start] = True
    word = np.cumsum(opens, dtype=np.int32) - 1
    plain = ~(np.add.reduceat(odd, w.start, dtype=np.int64) > 0)
    inside = wd.NOT_BLANK[data] & (word >= 0)
    cut = inside & plain[word]
    lowered = np.where((data >= 0x41) & (data <= 0x5A) | (after & (data >= 0x80) & (data <= 0x9E)), data + 32, data).astype(np.uint8)
    lowered = np.where(cut, lowered, data)
    kind = KIND[data]
    opens[1:] |= cut[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    start = np.flatnonzero(opens)
    own = word[start]
    end = np.minimum(np.append(start[1:], len(data)), w.end[own])
    row = w.row[own]
    return wd.Words(w.first, w.rows, lowered, w.offsets, start, end, row, np.searchsorted(row, np.arange(w.rows + 1)))


class UnitIds:
    """Ids of the units of text by a tokenizer, remembered by the units' 64-bit hashes.

    That a text's ids are those of its units, one after the other, is tried on
    texts made to show the contrary; where it fails ``checked`` is False and
    texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # the ids that end a unit
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()
        probes = ["a b", "A  b\n\nc", "it's 'll  's", " a\tb ", "x12 2y 3.4, . --x", "É e\u0301 SS×÷ ñandú ÀÞ", "<|endoftext|>a|b", "\x1f\x00a \x7f", "你好a1"]
        texts = [*probes, " ".join(probes)]
        self.checked = all((flat == self.encode(t)).all() if len(flat) == len(self.encode(t)) else False for t, flat in zip(texts, map(self.of_text, texts)))
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.size, self.flat, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of_text(self, text: str) -> np.ndarray:
        w = units(next(wd.words(pa.array([text], pa.string()))))
        place = self.places(w)
        return np.concatenate([self.flat[self.begin[p] : self.begin[p] + self.size[p]] for p in place] or [np.zeros(0, np.uint32)])

    def places(self, w: wd.Words) -> np.ndarray:
        """Where each unit's ids are; new ones are encoded first."""
        found, spot, which = np.unique(wd.word_hashes(w), return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != found[inside]
        if new.any():
            data = w.data.tobytes()
            texts = [data[a:b].decode() for a, b in zip(w.start[spot[new]].tolist(), w.end[spot[new]].tolist())]
            ids, size = self.encoded(texts)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)))
            self.flat[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(size) - size
            self.used += len(ids)
            self.hashes = np.insert(self.hashes, at[new], found[new])
            self.begin, self.size = np.insert(self.begin, at[new], begin), np.insert(self.size, at[new], size)
            at = np.searchsorted(self.hashes, found)
        return at[which]

    def encoded(self, texts: list[str], many: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and the number of each; a batch with a unit of several ends is encoded one by one."""
        ids, sizes = [], []
        for at in range(0, len(texts), many):
            part = texts[at : at + many]
            own = np.array(self.encode(" ".join(part)), np.uint32)
            ends = np.flatnonzero(self.ends[np.minimum(own, len(self.ends) - 1)])
            if len(ends) != len(part) or not len(ends) or ends[-1] != len(own) - 1 or not all(map(self.whole, part)):
                each = [np.array(self.encode(t), np.uint32) for t in part]
                own, ends = np.concatenate(each), np.cumsum([len(e) for e in each]) - 1
            ids.append(own)
            sizes.append(np.diff(ends, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    @staticmethod
    def whole(unit: str) -> bool:
        """Whether a unit surely has one end: letters, one digit, or marks."""
        return unit.isascii() and not ("'" in unit or "|" in unit) or unit.isalpha()


ENCODERS: dict[str, UnitIds] = {}


def encoder(path: str) -> UnitIds:
    if path not in ENCODERS:
        ENCODERS[path] = UnitIds(path)
    return ENCODERS[path]


def token_rows(column: pa.Array, path: str, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds of rows): the ids of runs of rows, ``end`` behind each text."""
    known = encoder(path)
    for w in wd.words(column):
        if not known.checked:
            rows = [known.encode(t or "") + [end] for t in column.slice(w.first, w.rows).to_pylist()]
            yield w.first, np.array([i for r in rows for i in r], np.uint32), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            continue
        w = units(w)
        place = known.places(w) if len(w.start) else np.zeros(0, np.int64)
        # each row's units, then the mark
        marks = w.bounds[1:] + np.arange(w.rows)
        take = np.insert(known.size[place], w.bounds[1:], 1)
        begin = np.insert(known.begin[place], w.bounds[1:], 0)
        past = np.cumsum(take)
        flat = known.flat[np.repeat(begin - (past - take), take) + np.arange(past[-1])]
        flat[past[marks] - 1] = end
        yield w.first, flat, np.concatenate(([0], past[marks]))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def pieces(path: str, end: int, length: int):
    """(doc_id, text) to whole sequences, as a place and a check sum, and the rest of each document with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, bounds in token_rows(batch.column(1), path, end):
                wide = flat if len(flat) and flat.max() > 0xFFFF else flat.astype(np.uint16)
                row, start, size, sums, ids = [], [], [], [], []
                for r, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    for at in range(lo, hi, length):
                        n = min(length, hi - at)
                        row.append(r)
                        start.append(at - lo)
                        size.append(n)
                        sums.append(crc(flat[at : at + n]))
                        ids.append(None if n == length else wide[at : at + n].tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.array(row, np.int64) + first)), pa.array(np.diff(bounds)[row], pa.int64()),
                    pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), pa.array(ids, pa.binary()),
                ], ["doc_id", "doc_tokens", "start", "length", "crc", "ids"])

    return run


class Rooms:
    """A tournament tree over the room left in bins: who is the first with enough?"""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        node, best = 1, self.best
        while node < self.leaves:
            node *= 2
            if best[node] < need:
                node += 1
        return node - self.leaves

    def take(self, bin: int, need: int) -> None:
        node, best = bin + self.leaves, self.best
        best[node] -= need
        while node > 1:
            node //= 2
            most = max(best[2 * node], best[2 * node + 1])
            if best[node] == most:
                break
            best[node] = most


def first_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Items of each bin, in order of placing; equal sizes keep their order."""
    bins: list[list[int]] = []
    rooms = Rooms(len(sizes), length)
    listed = sizes.tolist()
    for item in np.argsort(-sizes, kind="stable").tolist():
        bin = rooms.first(listed[item])
        rooms.take(bin, listed[item])
        if bin == len(bins):
            bins.append([])
        bins[bin].append(item)
    return bins


def filled(sizes: np.ndarray, length: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, first, size): first fit decreasing, then the emptiest bins are cut up to fill all others.

    As few bins as can fill the room in the rest are given up, so nearly all
    items stay whole. What is left over makes full bins, then ones of 2048, 1024,
    ... as its number of tokens has binary digits.
    """
    bins = first_fit_decreasing(sizes, length)
    full = np.array([sizes[b].sum() for b in bins], np.int64)
    order = np.argsort(full, kind="stable")
    had, open_ = np.cumsum(full[order]), (length - full[order])[::-1].cumsum()[::-1]
    given = int(np.argmax(had >= np.append(open_[1:], 0))) + 1 if len(bins) else 0
    if given and open_[0] == 0:
        given = 0  # all are full
    loose = [(item, 0, int(sizes[item])) for b in order[:given].tolist() for item in bins[b]][::-1]
    result = [[(item, 0, int(sizes[item])) for item in bins[b]] for b in np.sort(order[given:]).tolist()]

    def pour(bin: list[tuple[int, int, int]], room: int) -> None:
        while room:
            item, first, size = loose.pop()
            n = min(room, size)
            bin.append((item, first, n))
            room -= n
            if n < size:
                loose.append((item, first + n, size - n))

    for bin in result:
        pour(bin, length - sum(n for _, _, n in bin))
    left = sum(n for _, _, n in loose)
    digits = [1 << d for d in reversed(range(length.bit_length())) if (left % length) >> d & 1]
    for n in [length] * (left // length) + digits:
        result.append([])
        pour(result[-1], n)
    return result


def pack_group(length: int):
    """The pieces of one group to their places in sequences."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        size, sums = group.column("length").to_numpy(), group.column("crc").to_numpy()
        start, ids = group.column("start").to_numpy(), group.column("ids").combine_chunks()
        whole = np.flatnonzero(size == length)
        rest = np.flatnonzero(size < length)
        bins = [[(int(i), 0, length)] for i in whole]
        bins += [[(int(rest[i]), first, n) for i, first, n in b] for b in filled(size[rest], length)]
        item, first, n, sequence, offset, check = [], [], [], [], [], []
        for s, bin in enumerate(bins):
            at = 0
            for i, f, m in bin:
                item.append(i)
                first.append(int(start[i]) + f)
                n.append(m)
                sequence.append((key[0].as_py() << 32) + s)
                offset.append(at)
                at += m
                if m == size[i]:
                    check.append(int(sums[i]))
                else:
                    own = ids[i].as_buffer()
                    read = np.frombuffer(own, np.uint16 if own.size == 2 * size[i] else np.uint32)
                    check.append(crc(read[f : f + m]))
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array(item, pa.int64())), "start": pa.array(first, pa.int64()),
            "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(check, pa.int64()),
            "doc_tokens": group.column("doc_tokens").take(pa.array(item, pa.int64())),
            "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return run


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END,
           group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text by the tokenizer file ``tokenizer``,
    without special tokens, then ``end``. Each id lies in exactly one piece; a
    sequence holds at most ``length`` (a power of two) ids, its pieces lie side by
    side from 0; all are full but those whose length is a power of two. A null
    or empty text is the end id alone. Repeated rows and rows without an id are
    documents of their own. An empty table gives no rows. Other columns are
    ignored. The file must be readable on every executor.

    The pieces are stored first, so the number of groups is known and a task that
    is repeated meets the same pieces; only those that end a document carry ids.
    """
    if length & (length - 1):
        raise ValueError("length is a power of two")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = PIECE.format(id=source.schema["doc_id"].dataType.simpleString())
    cut = source.mapInArrow(pieces(tokenizer, end, length), schema).withColumn("row", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("pieces")).first()
    groups = max(1, -(-total.tokens // group_tokens), -(-total.pieces // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    result = f"doc_id {schema.split(', ')[0].split(' ', 1)[1]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(pack_group(length), result)
