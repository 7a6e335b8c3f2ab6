"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is described
by the make-up of its bytes and words, encoded by a small learned layer, and
weighed by gated attention; the score reads the weighted sum of encodings. Only
labels of documents are needed: which passages matter is learned with the rest.

Passages are described in NumPy over Arrow chunks of whole rows. Training runs
over a bounded sample of labelled documents; scoring is one map over the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.llm.labelled import sample

#: Words of a passage.
PASSAGE = 64
#: Labelled documents of each class to learn from, and the passages up to which a document may teach.
SAMPLE, LONGEST = 2000, 512
HIDDEN, GATE, ROUNDS = 16, 8, 250

#: Kinds of bytes: each ASCII sign by itself, capitals, small letters, digits, blanks, controls, the rest.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KIND = np.full(256, len(SIGNS) + 5, np.int64)
KIND[:32], KIND[127] = len(SIGNS) + 4, len(SIGNS) + 4
KIND[[0x20, *range(0x09, 0x0E)]] = len(SIGNS) + 3
KIND[0x30:0x3A], KIND[0x61:0x7B], KIND[0x41:0x5B] = len(SIGNS) + 2, len(SIGNS) + 1, len(SIGNS)
for _i, _c in enumerate(SIGNS):
    KIND[ord(_c)] = _i
KINDS, BUCKETS = len(SIGNS) + 6, 24
FEATURES = KINDS + 7 + BUCKETS


def passages(w: wd.Words, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features, rows): one line a passage; a text without words has one passage of no words."""
    count = np.diff(w.bounds)
    per_row = np.maximum(1, -(-count // size))
    row = np.repeat(np.arange(w.rows), per_row)
    base = np.cumsum(per_row) - per_row
    n = len(row)
    of_word = base[w.row] + (np.arange(len(w.start)) - w.bounds[w.row]) // size
    # a byte belongs to the passage of the last word that began before it, in its own row
    opens = np.zeros(len(w.data) + 1, np.int64)
    first = np.concatenate(([True], np.diff(of_word) > 0)) if len(of_word) else np.zeros(0, bool)
    np.add.at(opens, np.minimum(w.offsets[:-1], len(w.data)), 1)
    later = w.start[first & ((np.arange(len(w.start)) - w.bounds[w.row]) > 0)]
    np.add.at(opens, later, 1)
    of_byte = np.cumsum(opens)[: len(w.data)] - 1
    bytes_of = np.bincount(of_byte * KINDS + KIND[w.data], minlength=n * KINDS).reshape(n, KINDS).astype(np.float32)
    total = np.maximum(1, bytes_of.sum(1, keepdims=True))

    words = np.bincount(of_word, minlength=n).astype(np.float32)
    some = np.maximum(1, words)
    length = (w.end - w.start).astype(np.float32)
    mean = np.bincount(of_word, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, length**2, n) / some - mean**2))
    hashes = wd.word_hashes(w)
    order = np.lexsort((hashes, of_word))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][fresh], minlength=n) / some
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    short = np.bincount(of_word, length <= 3, n) / some
    stutter = np.bincount(of_word, same, n) / some
    buckets = np.bincount(of_word * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    x = np.hstack((
        np.sqrt(bytes_of / total), np.log1p(words)[:, None], np.log1p(mean)[:, None], np.log1p(spread)[:, None], distinct[:, None],
        short[:, None], stutter[:, None], np.log1p(per_row[row])[:, None], np.sqrt(buckets / some[:, None]),
    ))
    return x.astype(np.float32), row


@dataclass
class Model:
    """Weights by name, and the mean and spread of features in training."""

    weights: dict[str, np.ndarray]
    centre: np.ndarray
    scale: np.ndarray


def forward(x: np.ndarray, starts: np.ndarray, bag: np.ndarray, p: dict[str, np.ndarray]) -> tuple:
    h = np.tanh(x @ p["encode"] + p["encode_bias"])
    t, g = np.tanh(h @ p["look"]), 1 / (1 + np.exp(-(h @ p["gate"])))
    e = (t * g) @ p["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["read"] + p["read_bias"], -30, 30)))


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Full-batch Adam over bags; ``bag`` numbers the bags from 0 without gaps, in order."""
    centre, scale = x.mean(0), x.std(0) + 0.05
    x = (x - centre) / scale
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {
        "encode": rng.normal(0, d**-0.5, (d, HIDDEN)), "encode_bias": np.zeros(HIDDEN),
        "look": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "attend": rng.normal(0, GATE**-0.5, GATE), "read": rng.normal(0, HIDDEN**-0.5, HIDDEN), "read_bias": np.zeros(1),
    }
    starts = np.flatnonzero(np.diff(bag, prepend=-1))
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        h, t, g, a, z, out = forward(x, starts, bag, p)
        d_out = weight * (out - y) / weight.sum()
        d_z = d_out[:, None] * p["read"]
        d_a = (h * d_z[bag]).sum(1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, starts)[bag])
        d_tg = d_e[:, None] * p["attend"]
        d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
        d_h = a[:, None] * d_z[bag] + d_t @ p["look"].T + d_g @ p["gate"].T
        d_pre = d_h * (1 - h**2)
        grads = {
            "encode": x.T @ d_pre, "encode_bias": d_pre.sum(0), "look": h.T @ d_t, "gate": h.T @ d_g,
            "attend": (t * g).T @ d_e, "read": z.T @ d_out, "read_bias": np.array([d_out.sum()]),
        }
        for k, grad in grads.items():
            grad = grad + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            p[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model({k: w.astype(np.float32) for k, w in p.items()}, centre, scale)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) to (label, passages as float32 bytes)."""
    for batch in batches:
        for w in wd.words(batch.column(1)):
            x, row = passages(w)
            cuts = np.searchsorted(row, np.arange(w.rows + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(w.first, w.rows), batch.column(2).slice(w.first, w.rows),
                pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in range(w.rows)], pa.binary())], ["doc_id", "label", "passages"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = SAMPLE,
          longest: int = LONGEST) -> Model | None:
    """A model from at most ``rows`` usable labelled documents of each class and of ``longest`` passages each.

    Classes weigh as often as they occur among the usable labels. None unless
    there are documents of both classes.
    """
    known = labels.where(usable).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    prior = {r.label: r.n for r in known.where("label in (0, 1)").collect()}
    drawn = sample(docs, labels, label, usable, rows).mapInArrow(describe, "doc_id long, label int, passages binary")
    seen = drawn.where(F.octet_length("passages") <= 4 * FEATURES * longest).orderBy("doc_id", "passages").collect()
    bags = [np.frombuffer(r.passages, np.float32).reshape(-1, FEATURES) for r in seen]
    y = np.array([r.label for r in seen], float)
    if not len(y) or y.min() == y.max():
        return None
    weight = np.where(y > 0, prior[1] / y.sum(), prior[0] / (1 - y).sum())
    return train(np.vstack(bags).astype(np.float64), np.repeat(np.arange(len(bags)), list(map(len, bags))), y, weight)


def scored(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, ...), score (0 to 1), n_passages and top (the passage of most attention).

    The whole text counts. Null, empty and blank texts are one passage without
    words; rows that repeat are scored alike; without a model every score is 0.5;
    an empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.struct(*keep).alias("_key"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wd.words(batch.column(1)):
                x, row = passages(w)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                if model is None:
                    score, top = np.full(w.rows, 0.5), np.zeros(w.rows, np.int64)
                else:
                    *_, a, _, score = forward(((x - model.centre) / model.scale).astype(np.float32), starts, row, model.weights)
                    at = np.lexsort((-a, row))
                    top = at[starts] - starts
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.first, w.rows), pa.array(np.asarray(score, np.float64)),
                    pa.array(np.diff(np.append(starts, len(row))), pa.int64()), pa.array(top, pa.int64())],
                    ["_key", "score", "n_passages", "top"])

    schema = f"_key {source.schema['_key'].dataType.simpleString()}, score double, n_passages long, top long"
    return source.mapInArrow(run, schema).select("_key.*", "score", "n_passages", "top")
