"""Runs found on grammars against plain search for every period."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import periodic
from loomdex.llm.queries import op13_periodic_runs, planted


def plain_runs(words, shortest=24, periods=3):
    """All (start, length, smallest period), by trying every period."""
    n, best = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, periods * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def found_runs(words):
    hashes = np.array([zlib.crc32(str(w).encode()) for w in words], np.uint64)
    found = periodic.runs_of_rows(hashes, np.array([0, len(words)]))
    return [(s, e - s, q) for s, e, q in found.get(0, [])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 12)), max_size=8))
def test_runs_equal_plain_search(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert found_runs(words) == plain_runs(words)


@pytest.mark.parametrize("unit, times, tail", [(1, 500, 0), (7, 30, 3), (40, 9, 11), (333, 3, 0), (333, 5, 250), (8, 3, 0), (9, 3, 8), (2, 12, 0), (1, 23, 0)])
def test_one_run_in_noise(unit, times, tail):
    rng = random.Random(unit * times)
    block = [rng.randrange(10**6) for _ in range(unit)]
    noise = [rng.randrange(10**6, 10**7) for _ in range(100)]
    words = noise + block * times + block[:tail] + noise[::-1]
    assert found_runs(words) == plain_runs(words) == ([(100, unit * times + tail, unit)] if unit * times >= 24 else [])


def test_nested_and_neighbouring_runs():
    inner = ["a"] * 30 + ["b", "c", "d", "e"]
    words = inner * 4 + ["x"] * 40 + ["x", "y"] * 30 + [str(i) for i in range(50)] + inner * 3
    assert found_runs(words) == plain_runs(words)
    fibonacci = ["a", "b"]
    a, b = ["a"], ["a", "b"]
    for _ in range(12):
        a, b = b, b + a
    assert found_runs(b) == plain_runs(b)
    assert found_runs(fibonacci * 200) == [(0, 400, 2)]


def test_rows_of_a_chunk_do_not_meet():
    hashes = np.array([5] * 20 + [5] * 20 + [1, 2] * 20, np.uint64)
    assert periodic.runs_of_rows(hashes, np.array([0, 20, 40, 80])) == {2: [(0, 40, 2)]}


def test_a_grammar_derives_its_text():
    rng = random.Random(3)
    ids = [rng.randrange(3) for _ in range(400)]
    g = periodic.Grammar(ids, [(0, 150), (150, 400)], 3)

    def spelled(symbol):
        return [symbol] if symbol < 3 else [w for half in g.rules[symbol - 3][:2] for w in spelled(half)]

    assert [w for row in g.axioms for symbol, _ in row for w in spelled(symbol)] == ids
    everywhere = g.everywhere(set(range(len(g.rules))))
    for x, places in everywhere.items():
        word = spelled(x + 3)
        assert len(word) == g.rules[x][2] and all(ids[p : p + len(word)] == word for p in places.tolist())


def test_odd_rows(spark, docs, no_docs):
    rows = {}
    for r in periodic.periodic_runs(docs, keep=("doc_id", "hash")).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == docs.count()
    assert [len(rows[i]) for i in (1, None)] == [2, 2]
    for i in (20, 21, 22):
        assert (rows[i][0].n_words, rows[i][0].runs, rows[i][0].collapsed) == (0, [], "")
    assert [tuple(r) for r in rows[26][0].runs] == [(0, 90, 1)] and rows[26][0].collapsed == "ba"
    assert [tuple(r) for r in rows[31][0].runs] == [(0, 60, 3)] and rows[31][0].collapsed == "é ü ñ"
    assert rows[30][0].n_words == 20_000 and rows[1][0].hash == "clash"
    assert periodic.periodic_runs(no_docs).count() == 0


def test_the_query_on_planted_and_missing_ids(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randrange(50)) for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [(None, "a b " * 30), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for i, text in rows:
        words = (text or "").split()
        index = planted(i, len(words))
        words = words if index is None else [words[j] for j in index]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        wanted.append((i, len(runs), *best))
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and sum(r[1] for r in got) >= 4
