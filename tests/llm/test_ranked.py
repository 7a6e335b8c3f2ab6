"""Ranked search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pytest

from loomdex.llm import ranked
from loomdex.llm.queries import op11_ranked_search
from loomdex.llm.oracle import OP11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    split = [(i, terms(t)) for i, t in docs]
    total, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in items:
        found = []
        for doc_id, t in split:
            score = 0
            for w in set(terms(text)) & set(t):
                tf, m = t.count(w), 50 + 50 * len(t) * total // length
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score:
                found.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top]):
            rows.append((item, rank + 1, doc_id, -score))
    return sorted(rows, key=str)


ITEMS = [(1, "kaba LOFI, miha!"), (2, "kaba kaba neje kaba"), (3, None), (4, ""), (5, "unheard of"), (6, "É ü one two"), (7, "kaba lofi"), (7, "kaba lofi"), (None, "ba ky")]


@pytest.mark.parametrize("top, block, items, shard, leaf", [(50, 8192, 2048, 4096, 16), (3, 4, 2, 64, 1), (1, 8192, 2048, 64, 5)])
def test_equals_plain_scoring(spark, docs, texts, top, block, items, shard, leaf):
    extra = [(100 + i, " ".join(random.Random(i % 40).choices(["kaba", "lofi", "miha", "neje", "saky", "x"], k=30))) for i in range(400)]
    whole = docs.select("doc_id", "text", "hash").union(spark.createDataFrame([(*r, "z") for r in extra], "doc_id long, text string, hash string")).repartition(3)
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.ranked(whole, table, top, block, items, shard, leaf).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(texts + extra, ITEMS, top)


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for found in (ranked.ranked(no_docs, items), ranked.ranked(docs, items.limit(0)), ranked.ranked(docs.where("text is null"), items)):
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_nodes_bound_what_is_below_and_branches_are_left_out():
    rng = np.random.default_rng(4)
    rows, vocabulary = 600, 40
    vectors = [np.sort(rng.choice(vocabulary, rng.integers(0, 12), replace=False, p=np.arange(vocabulary, 0, -1) / 820)) for _ in range(rows)]
    bounds = np.cumsum([0, *map(len, vectors)])
    flat, tfs, m = np.concatenate(vectors), rng.integers(1, 9, bounds[-1]), rng.integers(50, 200, rows)
    tree = ranked.Tree(flat, tfs, bounds, m, vocabulary, 8)
    assert sorted(tree.order.tolist()) == list(range(rows))
    leaves = [(lo, hi) for lo, hi, c in zip(tree.low, tree.high, tree.children) if not c]
    assert sorted(leaves)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(leaves), sorted(leaves)[1:])) and len(leaves) > 30
    for i, (lo, hi) in enumerate(zip(tree.low, tree.high)):
        assert (tree.bound[i] >= tree.gives[lo:hi].max(0)).all() and tree.least[i] == tree.m[lo:hi].min()
    paths = [tuple(np.flatnonzero(t)) for t in tree.gives]
    assert paths == sorted(paths)
    looked = []
    score = tree.score
    tree.score = lambda table, *rest: looked.append(table is tree.gives) or score(table, *rest)
    item = ranked.Item(0, np.array([30, 35, 2]), np.array([5000.0, 6000.0, 10.0]))
    scores, docs = tree.search(item, np.arange(rows), (ranked.NONE, ranked.NONE), 5)
    every = score(tree.gives, slice(0, rows), item)
    assert sorted(scores.tolist()) == sorted(every.tolist())[-5:] and sum(looked) < len(leaves) / 2


def test_the_query_equals_its_sql(spark, sf):
    from tests.oracle import connect, differences

    assert differences(op11_ranked_search(spark, sf), connect(sf), OP11) == []
