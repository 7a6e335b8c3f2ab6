"""Operators on pairs and repeats against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomdex.llm import minhash, substring, vectors
from loomdex.llm.graph import components
from tests.llm.conftest import prose


def reach(n, linked):
    """Component of each of ``n`` items by brute force."""
    part = list(range(n))
    for a in range(n):
        for b in range(a):
            if part[a] != part[b] and linked(a, b):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = [new if p == old else p for p in part]
    return part


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected_near(rows):
    sets = [shingles(t) for _, t in rows]
    part = reach(len(rows), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    found = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        found.append((doc_id, len(sets[i]), least, doc_id == least))
    return Counter(found)


def test_near_duplicates_equal_brute_force(docs, texts):
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == expected_near(texts)


def test_one_row_of_each_group_stays(docs, texts):
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    wanted = {(i, t) for i, t in texts}
    near = {i for i, _, least, own in expected_near(texts) if own and i is not None}
    assert {i for i in ids if i is not None} == near and ids[1] == 1 and ids[None] == len({t for i, t in wanted if i is None})


def test_large_group_of_near_copies_and_mixed_buckets(spark):
    rng = random.Random(9)
    base = prose(rng, 100).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:70]) + " " + prose(rng, 60)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash.near_duplicates(docs, block=16).collect())) == expected_near(rows)


def test_members_of_the_largest_component_do_not_meet_each_other(spark):
    rows = [(1, 0, i, 0 if i < 900 else i, i % 2) for i in range(910)]
    rest = spark.createDataFrame(rows, "bucket long, band int, set long, component long, _class int")
    met = minhash.meetings(rest, 10).collect()
    assert len(met) < 4 * 900 + 10 * 4 * 60  # a block of strangers a class and copy, all blocks a stranger
    groups = {}
    for r in met:
        groups.setdefault((r["_low"], r["_up"], r["_i"], r["_j"]), []).append((r["side"], r["set"]))
    pairs = Counter()
    for group in groups.values():
        pairs.update({(min(a, b), max(a, b)) for s, a in group if s <= 0 for t, b in group if t >= 0 and a != b})
    wanted = {(a, b) for b in range(900, 910) for a in range(b)}
    assert wanted <= pairs.keys() and max(pairs[p] for p in wanted) == 1
    assert not any(b < 900 for _, b in pairs)


def test_no_documents_no_rows(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == [] and minhash.deduplicated(no_docs).collect() == []
    assert substring.without_repeats(no_docs).collect() == []


def test_pruning_rarely_loses_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (4000, 96), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.75, a, a + 1).astype(np.uint32)
    far = np.where(rng.random(a.shape) < 0.3, a, a + 1).astype(np.uint32)
    assert minhash.survive(a, b, 0.75, 32, 1e-4).mean() > 0.998
    assert minhash.survive(a, far, 0.75, 32, 1e-4).mean() < 0.001


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{j: 100 for j in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def expected_left(rows, k):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    windows = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    found = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if windows[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        found.append((doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return Counter(found)


@pytest.mark.parametrize("window", [35, 7])
def test_repeated_windows_equal_brute_force(docs, texts, window):
    assert Counter(map(tuple, substring.without_repeats(docs, window).collect())) == expected_left(texts, window)


def test_places_past_the_packed_range(spark, monkeypatch):
    rng = random.Random(2)
    passage = prose(rng, 50)
    rows = [(1, f"{prose(rng, 300)} {passage} {prose(rng, 90)}"), (2, f"{prose(rng, 10)} {passage}"), (3, prose(rng, 100))]
    assert substring.LAST_PLACE == 2**20 - 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring.without_repeats(docs).collect())) == expected_left(rows, 35)


def expected_links(rows, cosine=0.9):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        v, w = rows[a][1], rows[b][1]
        if a == b or not good(v) or not good(w) or len(v) != len(w):
            return False
        v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
        return v @ w / math.sqrt((v @ v) * (w @ w)) >= cosine

    part = reach(len(rows), linked)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, sum(linked(i, j) for j in range(len(rows))), least, vec_id == least))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"cell": 6, "z": None}, {"cell": 6, "block": 4, "chunk": 5, "z": None}])
def test_vector_links_equal_brute_force(spark, options):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    points = np.concatenate((base, base[:6] + 0.1 * rng.normal(size=(6, 16)), np.repeat(base[:1], 12, 0) + 0.12 * rng.normal(size=(12, 16))))
    rows = [(i, [float(x) for x in np.float32(p)]) for i, p in enumerate(points)]
    rows += [(50, rows[0][1]), (51, [2 * x for x in rows[1][1]]), (52, None), (53, [0.0] * 16), (54, [None] + [1.0] * 15), (0, rows[0][1]),
             (55, [float("nan")] * 16), (56, [float("inf")] + [1.0] * 15), (57, []), (58, [1.0, 2.0]), (59, [1.0, 2.0]), (None, rows[2][1]), (60, [-0.0] * 16)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, home string")
    assert Counter(map(tuple, vectors.similar_vectors(table, **options).collect())) == expected_links(rows)
    assert vectors.similar_vectors(table.limit(0)).collect() == []


def test_vector_recall_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    pairs = np.concatenate((base, 0.905 * base + math.sqrt(1 - 0.905**2) * side))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(pairs)]
    found = vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=64)
    assert found.where("n_links > 0").count() / len(rows) > 0.98
