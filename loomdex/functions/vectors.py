"""Column functions over array<float> vectors; arithmetic is in double."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    )


#: Tokens whose hash a Python worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 17, 64
TEXTS_AT_ONCE = 64


class Hashes(dict):
    """The first 32 bits of each token's MD5; frequent tokens are hashed once."""

    def __missing__(self, token: bytes) -> int:
        value = int.from_bytes(hashlib.md5(token, usedforsecurity=False).digest()[:4], "big")
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = value
        return value


hashes = Hashes()
SURROGATE = re.compile(rb"\xed[\xa0-\xbf][\x80-\xbf]")  # one wrong character to Spark, three to Python


def well_formed(text: bytes) -> bytes:
    """As Spark's own functions read a text that is no UTF-8."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return SURROGATE.sub(b"\xef\xbf\xbd", text).decode("utf-8", "replace").encode()


def token_counts(texts: pa.Array, width: int) -> pa.Array:
    """Counts of the tokens of each UTF-8 text (binary) in ``width`` buckets; null stays null."""
    pieces = [np.zeros(0, np.float32)]
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        # bytes are split at blanks, tabs, line ends, vertical tabs and form feeds, as at \s
        split = [well_formed(t).split() if t is not None else [] for t in texts.slice(i, TEXTS_AT_ONCE).to_pylist()]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        found = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        places = np.repeat(np.arange(len(split)) * width, sizes) + found % width
        pieces.append(np.bincount(places, minlength=len(split) * width).astype(np.float32))
    offsets = pa.array(np.arange(len(texts) + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pieces)), mask=texts.is_null())


def hashed_vector(text: Column, width: int = 64) -> Column:
    """Bag of tokens hashed into ``width`` buckets, a batch of texts at a time; no shuffle.

    Linear in tokens and width. What a worker holds beside its batch is bounded.
    """

    @F.arrow_udf("array<float>")
    def counted(texts: pa.Array) -> pa.Array:
        return token_counts(texts, width)

    return counted(text.cast("binary"))
