import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import queries as catalogue
from loomdex.operators import ann, dedup, knn, packing
from tests import brute


def make_index(spark, n=300, width=6, seed=1, copies=120):
    """Vectors in two spaces; the first ``copies`` rows share one vector, some are zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, (n, width)).astype(float)
    vectors[:copies] = vectors[0]
    vectors[5] = 0
    rows = [(f"c{i:04d}", "code" if i % 3 else "text", "class" if i % 2 else "function", i, [float(v) for v in vectors[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "chunk_id string, space string, kind string, start_line int, embedding array<float>")
    return df.repartition(5), {r[0]: r[4] for r in rows}, {r[0]: r for r in rows}


def make_queries(spark, n=23, width=6, seed=2):
    vectors = np.random.default_rng(seed).integers(-3, 4, (n, width)).astype(float)
    vectors[3:4] = 0
    rows = [(i, [float(v) for v in vectors[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<float>"), dict(rows)


@pytest.fixture(params=["whole", "slices"])
def either_way(request, monkeypatch):
    """All queries at once, and in slices as beyond the broadcast bound."""
    if request.param == "slices":
        monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 5)


def test_exact_equals_brute_force_with_ties(spark, either_way):
    index, vectors, _ = make_index(spark)
    queries, asked = make_queries(spark)
    brute.same(knn.nearest(index, queries, 7).collect(), brute.nearest(vectors, asked, 7))


def test_small_work_units_give_the_same(spark, monkeypatch):
    index, vectors, _ = make_index(spark)
    queries, asked = make_queries(spark)
    monkeypatch.setattr(knn, "CELLS_AT_ONCE", 100)
    monkeypatch.setattr(knn, "EXACT_AT_ONCE", 10)
    brute.same(knn.nearest(index, queries, 7).collect(), brute.nearest(vectors, asked, 7))


def test_k_larger_than_the_index_gives_all(spark, either_way):
    index, vectors, _ = make_index(spark, n=12, copies=4)
    queries, asked = make_queries(spark, 3)
    brute.same(knn.nearest(index, queries, 50).collect(), brute.nearest(vectors, asked, 50))


def test_own_k_scopes_and_filters(spark, either_way):
    index, vectors, rows = make_index(spark)
    _, asked = make_queries(spark)
    k = {q: 1 + q % 4 for q in asked}
    scopes = {q: [["code"], ["text"], None][q % 3] for q in asked}
    where = {q: [None, {"kind": "class"}, {"start_line": {"$lt": 200}}, {"kind": {"$nin": ["class", "function", "file"]}}][q % 4] for q in asked}
    queries = spark.createDataFrame(
        [(q, asked[q], k[q], scopes[q], where[q] and json.dumps(where[q])) for q in asked],
        "query_id bigint, embedding array<float>, k int, scopes array<string>, where string",
    )

    def allowed(q, i):
        row = rows[i]
        passes = {0: True, 1: row[2] == "class", 2: row[3] < 200, 3: False}[q % 4]
        return passes and (scopes[q] is None or row[1] in scopes[q])

    expected = {key: v for key, v in brute.nearest(vectors, asked, 4, allowed).items() if v[0] <= k[key[0]]}
    brute.same(knn.nearest(index, queries, 5).collect(), expected)


def test_widths_and_nulls_never_meet(spark, either_way):
    rows = [("a", "code", [1.0, 0.0]), ("b", "code", [0.0, 1.0, 0.0]), ("c", "text", None), ("d", "text", [1.0, 1.0])]
    index = spark.createDataFrame(rows, "chunk_id string, space string, embedding array<float>")
    queries = spark.createDataFrame(
        [(1, [1.0, 0.1], ["code"]), (1, [1.0, 0.1, 0.0], ["text"]), (2, None, None), (3, [0.0, 1.0, 0.0], None)],
        "query_id bigint, embedding array<float>, scopes array<string>",
    )
    got = {(r["query_id"], r["chunk_id"]) for r in knn.nearest(index, queries, 5).collect()}
    assert got == {(1, "a"), (3, "b")}


def test_no_queries_no_index(spark, either_way):
    index, _, _ = make_index(spark, 10, copies=2)
    queries, _ = make_queries(spark, 2)
    assert knn.nearest(index, queries.where("false"), 3).count() == 0
    assert knn.nearest(index.where("false"), queries, 3).count() == 0


def test_exclude_self_keeps_k(spark, either_way):
    index, vectors, _ = make_index(spark, 60, copies=20)
    queries = index.select(F.col("chunk_id").alias("query_id"), "embedding")
    expected = brute.nearest(vectors, vectors, 4, lambda q, i: q != i)
    brute.same(knn.nearest(index, queries, 4, exclude_self=True).collect(), expected)


def test_per_scope(spark, either_way):
    index, vectors, rows = make_index(spark, 90, copies=30)
    queries, asked = make_queries(spark, 5)
    hits = knn.nearest(index, queries, 3, per_scope=True).collect()
    for scope in ("code", "text"):
        expected = brute.nearest(vectors, asked, 3, lambda q, i: rows[i][1] == scope)
        brute.same([h for h in hits if h["scope"] == scope], expected)


def test_one_query_plan_does_not_shuffle_vectors(spark, capsys):
    index, _, _ = make_index(spark, 30, copies=3)
    queries, _ = make_queries(spark, 2)
    knn.nearest(index, queries, 3, where={"kind": "class"}).explain("formatted")
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1


# --- approximate -----------------------------------------------------------


def setup_cells(spark, trained):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    points = np.concatenate([m + 0.3 * rng.normal(size=(50, 16)) for m in middles])
    rows = [(i, "code", [float(x) for x in p]) for i, p in enumerate(points)]
    index = spark.createDataFrame(rows, "chunk_id bigint, space string, embedding array<float>")
    centres = ann.trained_centres(index, 12) if trained else ann.sampled_centres(index, 24)
    centres = spark.createDataFrame(centres.collect(), centres.schema)
    vectors = {r["chunk_id"]: r["embedding"] for r in index.collect()}
    queries = index.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return ann.with_cell(index, centres), centres, vectors, queries


@pytest.mark.parametrize("trained", [False, True])
def test_recall_against_exact(spark, trained):
    index, centres, vectors, queries = setup_cells(spark, trained)
    asked = {r["query_id"]: r["embedding"] for r in queries.collect()}
    exact = brute.nearest(vectors, asked, 5)
    found = {(r["query_id"], r["chunk_id"]) for r in ann.nearest_approximate(index, queries, centres, 5, 3).collect()}
    assert len(found) == len(exact)
    assert len(found & exact.keys()) / len(exact) >= 0.9


def test_all_probes_is_exact_and_few_rows_still_fill_k(spark):
    index, centres, vectors, queries = setup_cells(spark, False)
    asked = {r["query_id"]: r["embedding"] for r in queries.collect()}
    brute.same(ann.nearest_approximate(index, queries, centres, 4, 10_000).collect(), brute.nearest(vectors, asked, 4))
    per_query = ann.nearest_approximate(index, queries, centres, 120, 1).groupBy("query_id").count()
    assert {r["count"] for r in per_query.collect()} == {120}


def test_trained_catalogue_query_fills_k_with_true_distances(spark, sf):
    rows = catalogue.knn_ann_trained(spark, sf).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in fx.table(spark, sf, "embeddings").collect()}
    assert len(rows) == 5 * len(vectors)
    for r in rows:
        assert abs(r["distance"] - (1 - brute.cosine(vectors[r["query_id"]], vectors[r["chunk_id"]]))) < 1e-5


# --- near duplicates -------------------------------------------------------


@pytest.mark.parametrize("threshold", [0.8, 0.95, 0.999])
@pytest.mark.parametrize("cells,block", [(1, 8192), (9, 8192), (9, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, threshold, cells, block):
    monkeypatch.setattr(dedup, "ROWS_PER_BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 8))
    points = np.concatenate([base, base + 0.15 * rng.normal(size=(25, 8)), base + 0.01 * rng.normal(size=(25, 8)), np.repeat(base[:1], 40, 0), np.zeros((3, 8))])
    order = rng.permutation(len(points))
    rows = [(f"{i:03d}", "text" if i % 11 == 0 else "code", [float(np.float32(x)) for x in points[p]]) for i, p in enumerate(order)]
    chunks = spark.createDataFrame(rows, "chunk_id string, space string, embedding array<float>")
    expected = {}
    for b in rows:
        near = [a[0] for a in rows if a[0] < b[0] and a[1] == b[1] and any(a[2]) and any(b[2]) and (a[2] == b[2] or brute.cosine(a[2], b[2]) >= threshold)]
        if near:
            expected[b[0]] = min(near)
    got = {r["chunk_id"]: r["duplicate_of"] for r in dedup.near_duplicates(chunks, threshold, cells).collect()}
    assert got == expected
    assert dedup.drop_near_duplicates(chunks, threshold, cells).count() == len(rows) - len(expected)


def test_near_duplicates_move_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS_PER_BLOCK", 16)
    moved, rng = {}, np.random.default_rng(5)
    base = rng.normal(size=(64, 16))
    for n in (1024, 4096):
        points = base[np.arange(n) % 64] + 0.5 * rng.normal(size=(n, 16))
        reps = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "chunk_id long, embedding array<float>")
        centres = dedup.spread_centres(reps, dedup.CELLS, 16)
        homes, guests = dedup.dealt(dedup.with_cells(reps, centres, 0.95), dedup.block_rows(n, 16))
        moved[n] = (homes.count() + guests.count()) / n
    assert moved[4096] <= 1.2 * moved[1024] and moved[4096] <= 2 * dedup.CELLS
    assert dedup.block_rows(3_000_000, 64) == 3_000_000 // dedup.CELLS
    assert dedup.block_rows(10**9, 64) * 64 * 4 == dedup.BLOCK_BYTES


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_first_partners_in_slabs_equal_brute_force(monkeypatch, threshold):
    monkeypatch.setattr(dedup, "SLAB", 7)
    monkeypatch.setattr(dedup, "CELLS_AT_ONCE", 35)
    rng = np.random.default_rng(9)
    raw = rng.normal(size=(150, 4))
    raw[::10] = raw[0] * np.linspace(1, 3, 15)[:, None]
    order = np.sort(rng.integers(0, 120, 150))  # some ids have several vectors
    norms = dedup.norms_of(raw)
    both = dedup.Side(order, order + 1000, raw, norms, dedup.unit(raw, norms))
    picks = rng.random(150) < 0.5
    got = dedup.first_partners(both.only(picks), both.only(~picks), threshold)
    got = {(int(b), int(a)) for b, a in got.itertuples(index=False)}
    expected = set()
    for b in np.flatnonzero(picks):
        near = [a for a in np.flatnonzero(~picks) if order[a] < order[b] and brute.cosine(raw[a], raw[b]) >= threshold]
        expected |= {(int(order[b]) + 1000, int(order[near[0]]) + 1000)} if near else set()
    assert got == expected and got


def test_vectors_and_ids_that_cannot_be_compared_hide_no_duplicate(spark):
    bad = [(f"n{i}", "code", [float("nan"), float(i), 1.0]) for i in range(20)]
    rows = [*bad, (None, "code", [1.0, 0.0, 0.0]), ("b", "code", [1.0, 0.01, 0.0]), ("a", "code", [1.0, 0.02, 0.0]), ("b", "code", [0.0, 1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, space string, embedding array<float>")
    assert {tuple(r) for r in dedup.near_duplicates(chunks, 0.9).collect()} == {("b", "a")}
    copies = chunks.where("chunk_id like 'n1%'").unionByName(chunks.where("chunk_id = 'n11'").withColumn("chunk_id", F.lit("z")))
    assert [tuple(r) for r in dedup.near_duplicates(copies, 0.9).collect()] == [("z", "n11")]


# --- packing ---------------------------------------------------------------


def test_budget_stops_at_the_first_chunk_that_does_not_fit(spark):
    hits = spark.createDataFrame(
        [(1, 1, 5, "a"), (1, 2, 9, "b"), (1, 3, 1, "c"), (2, 1, 11, "d"), (3, 1, 10, "e")],
        "query_id bigint, rank int, tokens bigint, text string",
    ).withColumns({"path": F.lit(None).cast("string"), "type": F.lit("class"), "name": F.lit(None).cast("string"),
                   "start_line": F.lit(None).cast("int"), "end_line": F.lit(7), "chunk_id": F.col("text"), "distance": F.lit(0.5)})
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id bigint")
    packed = packing.pack(hits, 10)
    answers = {r["query_id"]: r for r in packing.contexts(queries, packed).collect()}
    assert answers[1]["content"] == "File: unknown, Type: class, Name: , Lines: 1-7\na\n"
    assert [answers[q]["tokens"] for q in (1, 2, 3, 4)] == [5, 0, 10, 0]
    assert [len(answers[q]["metadata"]) for q in (1, 2, 3, 4)] == [3, 1, 1, 0]
    assert answers[2]["content"] == answers[4]["content"] == ""
    events = sorted(tuple(r) for r in packing.event_rows(queries, packed).select("query_id", "seq", "event", "data").collect())
    assert [(e[0], e[1], e[2]) for e in events] == [(1, 1, "chunk"), (1, 2, "end"), (2, 1, "end"), (3, 1, "chunk"), (3, 2, "end"), (4, 1, "end")]
    assert json.loads(events[0][3]) == {"content": "a", "metadata": {"path": "unknown", "type": "class", "name": "", "start_line": 1, "end_line": 7}}
    assert [json.loads(e[3])["tokens"] for e in events if e[2] == "end"] == [5, 0, 10, 0]
    two = packing.contexts(queries, packing.pack(hits, 14)).where("query_id = 1").first()
    assert two["content"].count("File: ") == 2 and "\n\nFile: " in two["content"] and two["tokens"] == 14


def test_budget_of_each_query(spark):
    hits = spark.createDataFrame([(1, 1, 5, 4), (2, 1, 5, 5)], "query_id bigint, rank int, tokens bigint, max_tokens bigint")
    assert {r["query_id"]: r["packed"] for r in packing.pack(hits).collect()} == {1: False, 2: True}


def test_event_text_round_trip(spark):
    texts = ['event: chunk\ndata: {"content": "A"}\n\n', "event: end\n\ndata:  5 \n", "plain", "event: x", "data: 1\nevent: y", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(packing.parse_event_text(F.col("t")).alias("e")).collect()
    got = [(r["e"]["event"], r["e"]["data"]) for r in rows]
    assert got == [("chunk", '{"content": "A"}'), ("end", "5")] + [("raw", t) for t in texts[2:]]
    made = spark.range(1).select(packing.event_text(F.lit("end"), F.lit('{"tokens":5}'))).first()[0]
    assert made == 'event: end\ndata: {"tokens":5}\n\n'


def test_near_duplicates_of_several_widths_and_of_nothing(spark):
    rows = [("a", "code", [1.0, 0.0, 0.0, 0.0]), ("b", "code", [1.0, 0.01, 0.0, 0.0]), ("c", "text", [1.0, 0.0] * 4), ("d", "text", [1.0, 0.0] * 4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, space string, embedding array<float>")
    assert sorted(dedup.near_duplicates(chunks, 0.9).collect()) == [("b", "a"), ("d", "c")]
    assert dedup.near_duplicates(chunks.limit(0), 0.9).count() == 0
    assert ann.with_cell(chunks.limit(0), ann.sampled_centres(chunks.limit(0), 4)).count() == 0


def test_more_centres_than_once_were_kept(spark):
    n = 5000
    points = spark.range(n).select(
        F.format_string("%05d", "id").alias("chunk_id"),
        F.array(F.cos(F.col("id") * 0.00125), F.sin(F.col("id") * 0.00125)).cast("array<float>").alias("embedding"))
    centres = points.select(F.col("chunk_id").alias("cell"), "embedding")
    placed = ann.with_cell(points.where("chunk_id >= '04990'"), centres)
    assert all(abs(int(r.cell) - int(r.chunk_id)) <= 1 for r in placed.collect())
    assert ann.trained_centres(points, 1).count() == 1


def test_copies_of_a_vector_are_not_all_held_at_one_time(monkeypatch):
    monkeypatch.setattr(knn, "PAIRS_AT_ONCE", 500, raising=False)
    monkeypatch.setattr(knn, "EXACT_AT_ONCE", 200)
    held, offer = [], knn.BestSoFar.offer
    monkeypatch.setattr(knn.BestSoFar, "offer", lambda self, frames: (held.append(sum(map(len, frames))), offer(self, frames))[1])
    asked = [[1.0, 0.1 * i] for i in range(40)]
    table = pa.table({
        "query_id": pa.array(range(40)), "embedding": pa.array(asked, pa.list_(pa.float32())), "k": pa.array([3] * 40, pa.int32()),
        "scopes": pa.nulls(40, pa.list_(pa.string())), "where": pa.nulls(40, pa.string())})
    best = knn.BestSoFar(knn.QueryBlock.of(table), False)
    vectors = [[1.0, 2.0]] * 900 + [[1.0, 0.0]] * 100  # ids fall, so that the last ones win
    best.scan(pa.RecordBatch.from_pydict({
        "chunk_id": pa.array(range(1000, 0, -1)), "scope": pa.array(["text"] * 1000), "embedding": pa.array(vectors, pa.list_(pa.float32()))}))
    assert max(held) <= 700
    found = best.result(pa.int64()).to_pandas().groupby("query_id")["chunk_id"].apply(sorted)
    near = {q: 1 if np.dot([1, 0], v) / np.hypot(*v) > np.dot([1, 2], v) / np.hypot(1, 2) / np.hypot(*v) else 101 for q, v in enumerate(asked)}
    assert {q: ids for q, ids in found.items()} == {q: [n, n + 1, n + 2] for q, n in near.items()}


def test_vectors_move_once_for_as_many_queries_as_a_task_holds(spark, monkeypatch):
    index, vectors, _ = make_index(spark)
    queries, asked = make_queries(spark)
    monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 5)
    read = spark.sparkContext.accumulator(0)

    class Counting(knn.BestSoFar):
        def scan(self, batch):
            read.add(batch.num_rows)
            super().scan(batch)

    rows = index.select("chunk_id", F.col("space").alias("scope"), "embedding")
    schema = "query_id bigint, chunk_id string, scope string, distance double, k int"
    found = knn.scan_in_tiles(rows, knn.query_rows(queries, 7, 0), schema, lambda block: Counting(block, False))
    brute.same(knn.ranked(found, ["query_id"]).collect(), brute.nearest(vectors, asked, 7))
    assert read.value <= 3 * len(vectors)  # 23 queries, of which 5 may be broadcast
    # the rows of 6 GB: vectors would move 102 times in groups of 8,192, and each hit 24 times with one group
    assert knn.grid(830_600, 830_600 * 64, 830_600 * 5, 3_077_000, 32, 8) == (8, 4)
    assert knn.grid(13_515, 13_515 * 64, 13_515 * 20, 51_282, 32, 8) == (5, 7)
    monkeypatch.setattr(knn, "GROUP_HITS", 50)  # and with many groups
    brute.same(knn.nearest(index, queries, 7).collect(), brute.nearest(vectors, asked, 7))


def test_small_strokes_find_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    rows, asked = rng.normal(size=(700, 8)).astype(np.float32), rng.normal(size=(33, 8)).astype(np.float32)
    monkeypatch.setattr(knn, "ROWS_AT_ONCE", 64)
    needed = np.full(33, 2.0)
    needed[:5] = -np.inf
    got = {(int(a), int(b)) for r, q in knn.reaching(rows, asked, needed, 10, 0.0) for a, b in zip(r, q)}
    sims = rows @ asked.T
    assert {p for p in got if p[1] >= 5} == {(a, b) for a, b in zip(*np.nonzero(sims >= 2)) if b >= 5}
    assert all({(int(r), q) for r in np.argsort(-sims[:, q])[:10]} <= got for q in range(5))
    mask = rng.random((37, 11)) < 0.03
    assert {tuple(map(int, p)) for p in zip(*knn.pairs_in(mask))} == {tuple(map(int, p)) for p in zip(*np.nonzero(mask))}


def test_the_budget_is_applied_before_texts_move(spark):
    rows = [(i, f"t{i}", 1 + i % 4, f"p{i}") for i in range(40)]
    index = spark.createDataFrame(rows, "chunk_id int, text string, tokens bigint, path string")
    hits = spark.createDataFrame([(q, (7 * q + r) % 45, 0.1 * r, r) for q in range(20) for r in range(1, 6)], "query_id int, chunk_id int, distance double, rank int")

    def same(index):
        plain, quick = packing.pack(packing.fetch_chunks(hits, index), 8), packing.fetch_packed(hits, index, 8)
        names = sorted(plain.columns)
        assert sorted(quick.columns) == names and sorted(quick.select(names).collect()) == sorted(plain.select(names).collect())
        return quick

    assert "Window" not in same(index)._jdf.queryExecution().optimizedPlan().toString()
    twice = index.unionByName(index.where("chunk_id = 9").withColumns({"text": F.lit("other"), "tokens": F.lit(0).cast("bigint")}))
    assert packing.fetch_packed(hits, twice, 8).count() == same(index).count() + hits.where("chunk_id = 9").count()


def test_texts_of_chunks_do_not_move_with_every_hit(spark):
    from loomdex.operators import ranking

    rows = [(i, f"w{i % 7} w{i % 3} x{i}") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string")
    asked = spark.createDataFrame([(q, f"w{q % 7} w{q % 3}") for q in range(12)], "query_id int, text string")
    hits = spark.createDataFrame([(q, (5 * q + r) % 60, 0.01 * r, r) for q in range(12) for r in range(1, 21)], "query_id int, chunk_id int, distance double, rank int")
    best = ranking.rerank(hits, chunks, asked, 3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "chunk_id" in joins[0] and "query_id" in joins[1]  # the outer one is by chunk
    texts, queries = dict(rows), {r["query_id"]: r["text"] for r in asked.collect()}
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in best.collect()}
    for q in queries:
        scored = []
        for h in hits.where(F.col("query_id") == q).collect():
            a, b = set(queries[q].split()), set(texts[h["chunk_id"]].split())
            scored.append((-len(a & b) / len(a | b), h["distance"], h["chunk_id"]))
        assert [got[q, r] for r in (1, 2, 3)] == [(c, round(-s, 9)) for s, _, c in sorted(scored)[:3]]
