"""The parameters of op5_embedding_dedup with many cells, on vectors of few effective dimensions."""

import numpy as np

from loomdex.llm import vectors


def test_links_across_many_cells_of_low_rank_vectors(spark):
    rng = np.random.default_rng(11)
    points = np.float32(rng.normal(size=(6000, 4)) @ rng.normal(size=(4, 64)) + 0.01 * rng.normal(size=(6000, 64)))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    found = vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    unit = points.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -1)
    assert not (abs(cosines - 0.9) < 1e-12).any() and len(rows) // vectors.CELL > 10
    assert found.n_links.tolist() == (cosines >= 0.9).sum(1).tolist()


def test_a_vector_moves_once_a_region_however_many_cells_it_visits(spark, monkeypatch):
    rng = np.random.default_rng(12)
    points = np.float32(rng.normal(size=(3000, 16)) + 1)
    moved, stored = [], vectors.materialize

    def watched(df, name):
        if name == "placed":
            found = stored(df, name)
            moved.append(found.selectExpr("max(size(visits)) as n").first().n)
            return found
        return stored(df, name)

    monkeypatch.setattr(vectors, "materialize", watched)
    found = vectors.similar_vectors(
        spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>"), cell=20, block=400, chunk=700)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True).astype(float)
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -1)
    assert [r.n_links for r in found.orderBy("vec_id").collect()] == (cosines >= 0.9).sum(1).tolist()
    assert moved[0] <= vectors.REGIONS < 3000 // 20
