"""Plain NumPy answers to check the distributed operators with."""

import numpy as np


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return float((a * b).sum() / size) if size else 0.0


def nearest(index, queries, k, allowed=lambda query, row: True):
    """index: id -> vector; queries: id -> vector; result: {(query, id): (rank, distance)}."""
    out = {}
    for q, qv in queries.items():
        hits = sorted((1 - cosine(qv, v), i) for i, v in index.items() if len(v) == len(qv) and allowed(q, i))
        out.update({(q, i): (rank, d) for rank, (d, i) in enumerate(hits[:k], 1)})
    return out


def same(rows, expected):
    got = {(r["query_id"], r["chunk_id"]): (r["rank"], r["distance"]) for r in rows}
    assert got.keys() == expected.keys()
    for key, (rank, distance) in expected.items():
        assert got[key][0] == rank and abs(got[key][1] - distance) < 1e-9
