"""Index runs and the streams that drive them."""

import datetime as dt
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomdex import Indexer, Searcher
from loomdex.functions.constants import CODE_MODEL
from loomdex.operators import chunking, embedding, logs, tables
from loomdex.operators.ranking import jaccard
from loomdex.plans import indexer as indexer_module
from loomdex.plans.cells import CellIndex
from loomdex.sources import requests
from loomdex.streaming import jobs

FILES = "path string, content string, mtime timestamp"
T0 = dt.datetime(2024, 1, 1)


def files(spark, versions):
    """{path: (content, hours)} as a table."""
    rows = [(p, c, T0 + dt.timedelta(hours=h)) for p, (c, h) in versions.items()]
    return spark.createDataFrame(rows, FILES)


FIRST = {
    "a.py": ("def add(a, b):\n    return a + b\n", 0),
    "b.py": ("class Box:\n    def get(self):\n        return 1\n\ndef use():\n    pass\n", 0),
    "c.md": ("how to add numbers\n", 0),
}
SECOND = {
    "a.py": ("def add(a, b, c):\n    return a + b + c\n", 1),
    "b.py": ("ignored: this version is not newer\n", 0),
    "d.js": ("function four() {\n  return 4;\n}\n", 1),
}


def snapshot(table):
    return sorted((r["path"], r["type"], r["name"], r["start_line"], r["end_line"]) for r in table.collect())


EXPECTED = [("a.py", "function", "add", 1, 2), ("b.py", "class", "Box", 1, 3), ("b.py", "function", "use", 5, 6), ("c.md", "file", "c.md", 1, 1)]
AFTER = [("a.py", "function", "add", 1, 2), ("b.py", "class", "Box", 1, 3), ("b.py", "function", "use", 5, 6), ("d.js", "function_declaration", "four", 1, 3)]


@pytest.fixture
def indexer(spark, tmp_path):
    return Indexer(spark, str(tmp_path / "index"))


def test_full_run_twice_is_one(spark, indexer):
    assert indexer.store.vectors().count() == indexer.store.chunks().count() == 0
    assert indexer.index_full(files(spark, FIRST)) == {"run": 1, "files": 3, "deleted": 0, "chunks": 4}
    assert indexer.index_full(files(spark, FIRST))["run"] == 2
    assert snapshot(indexer.store.vectors()) == snapshot(indexer.store.chunks()) == EXPECTED
    assert indexer.store.cache("1").count() == 4  # nothing embedded twice


def test_incremental_equals_full_after_changes(spark, indexer, tmp_path):
    indexer.index_full(files(spark, FIRST))
    assert indexer.index_incremental(files(spark, FIRST)) == {"run": 1, "files": 0, "deleted": 0, "chunks": 0}
    assert indexer.index_incremental(files(spark, SECOND)) == {"run": 2, "files": 2, "deleted": 1, "chunks": 2}
    assert snapshot(indexer.store.vectors()) == snapshot(indexer.store.chunks()) == AFTER
    state = {r["path"]: r["mtime"] for r in indexer.store.file_state().collect()}
    assert set(state) == {"a.py", "b.py", "d.js"} and state["a.py"] == T0 + dt.timedelta(hours=1)
    # a deleted file that comes back with its old mtime is indexed again
    assert indexer.index_incremental(files(spark, {**SECOND, "c.md": FIRST["c.md"]}))["chunks"] == 1
    other = Indexer(spark, str(tmp_path / "other"))
    now = {**SECOND, "b.py": FIRST["b.py"], "c.md": FIRST["c.md"]}
    other.index_full(files(spark, now))
    columns = ["chunk_id", "path", "space", "embedding", "norm", "tokens"]
    mine, theirs = (sorted(map(str, i.store.vectors().select(*columns).collect())) for i in (indexer, other))
    assert mine == theirs


def test_refresh_reads_changed_files_only(spark, indexer, tmp_path):
    project = tmp_path / "project"
    project.mkdir()
    for name, text in (("a.py", "def a(): pass\n"), ("b.py", "def b(): pass\n"), ("c.py", "def c(): pass\n")):
        (project / name).write_text(text)
        os.utime(project / name, (1_700_000_000, 1_700_000_000))
    assert indexer.refresh(str(project))["chunks"] == 3
    (project / "a.py").write_text("def a2(): pass\n")
    (project / "b.py").write_bytes(b"\x00")  # turned binary
    (project / "c.py").unlink()
    (project / "d.py").write_text("def d(): pass\n")
    assert indexer.refresh(str(project)) == {"run": 2, "files": 2, "deleted": 2, "chunks": 2}
    assert sorted(r["name"] for r in indexer.store.vectors().collect()) == ["a2", "d"]
    assert indexer.refresh(str(project)) == {"run": 2, "files": 0, "deleted": 0, "chunks": 0}


def test_failed_run_leaves_no_trace(spark, indexer):
    indexer.index_full(files(spark, FIRST))

    def broken(text, model):
        return F.raise_error(F.lit("model is down")).cast("array<float>")

    failing = Indexer(spark, indexer.store.root, embedder=broken)
    with pytest.raises(Exception, match="model is down"):
        failing.index_incremental(files(spark, SECOND))
    assert snapshot(indexer.store.vectors()) == EXPECTED
    indexer.index_incremental(files(spark, SECOND))
    assert snapshot(indexer.store.vectors()) == AFTER


def test_reembed_stale(spark, indexer):
    indexer.index_full(files(spark, FIRST))

    def other_embedder(text, model):
        return F.array(F.length(text).cast("float"), F.lit(1).cast("float"))

    newer = Indexer(spark, indexer.store.root, embedder=other_embedder, index_version="2")
    assert newer.reembed_stale()["chunks"] == 4
    rows = newer.store.vectors().collect()
    assert {(r["index_version"], len(r["embedding"])) for r in rows} == {("2", 2)}  # no vector of the old embedder
    assert snapshot(newer.store.vectors()) == snapshot(newer.store.chunks()) == EXPECTED
    assert newer.reembed_stale()["chunks"] == 0


def test_pandas_embedder_sees_each_text_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def model(texts: pd.Series, models: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0])

    indexer = Indexer(spark, str(tmp_path / "i"), embedder=model)
    indexer.index_full(files(spark, {f"{i}.txt": ("same text", 0) for i in range(20)}))
    assert calls.value == 1 and indexer.store.vectors().count() == 20
    hits = Searcher.of(indexer.store, model).search("same text", k=3).collect()
    assert [h["rank"] for h in hits] == [1, 2, 3]


def test_store_round_trip(spark, indexer):
    indexer.index_full(files(spark, {"notes/warp.md": ("long threads cross short ones", 0)}))
    assert indexer.store.vectors().count() == 1
    hit = Searcher.of(indexer.store).search("long threads cross short ones", k=1).first()
    assert hit["text"] == "long threads cross short ones" and abs(hit["distance"]) < 1e-12


def test_index_and_search_end_to_end(spark, indexer, tmp_path):
    project = tmp_path / "project"
    project.mkdir()
    (project / "knots.py").write_text('def tie(rope, knot="reef"):\n    # tie a rope with a knot\n    return f"{rope}:{knot}"\n')
    indexer.index_full(indexer.scan(str(project)))
    searcher = Searcher.of(indexer.store)
    answer = searcher.context("tie a rope", k=3, max_tokens=1000).first()
    assert "Name: tie, Lines: 1-3" in answer["content"] and answer["tokens"] == 12
    assert searcher.context("x", metadata_filter={"type": "class"}).first()["content"] == ""
    kept = searcher.persist()
    assert kept.context("tie a rope", k=3, max_tokens=1000).first() == answer
    kept.unpersist()
    assert [r["event"] for r in searcher.stream_events("rope").orderBy("seq").collect()] == ["chunk", "end"]


def test_cells_with_all_probes_equal_the_exact_search(spark, indexer, tmp_path):
    texts = {f"{'p' if i % 2 else 't'}{i}.{'py' if i % 2 else 'md'}": (f"w{i % 7} w{i % 5} w{i % 3} x{i}", 0) for i in range(60)}
    indexer.index_full(files(spark, texts))
    cells = CellIndex.build(indexer.store.vectors(), str(tmp_path / "cells"), cells=5)
    queries = spark.createDataFrame([(1, "w1 w2", 4, None), (2, "w6 x13", 2, '{"lang": "python"}'), (3, "none", 3, None)], "query_id bigint, text string, k int, where string")
    exact = Searcher.of(indexer.store).hits(queries)
    rows = {probes: sorted(map(tuple, Searcher.of(indexer.store, cells=cells, probes=probes).hits(queries).select(*exact.columns).collect())) for probes in (1, 99)}
    assert rows[99] == sorted(map(tuple, exact.collect()))
    assert [r[0] for r in rows[1]] == [r[0] for r in rows[99]]  # never short of k
    assert CellIndex(spark, str(tmp_path / "cells")).vectors.count() == 60


def test_a_language_more(spark, tmp_path):
    more = chunking.BUILT_IN.having(".rs", "rust", [("function_item", r"^(?P<at>(?:pub\s+)?fn\s+(?P<name>\w+))")])
    indexer = Indexer(spark, str(tmp_path / "index"), languages=more)
    indexer.index_full(files(spark, {"a.rs": ("pub fn one() {\n  1 // }\n}\nfn two() {}\n", 0)}))
    assert snapshot(indexer.store.chunks()) == [("a.rs", "function_item", "one", 1, 3), ("a.rs", "function_item", "two", 4, 4)]


def test_rerank_and_options(spark, indexer):
    indexer.index_full(files(spark, {**FIRST, "e.md": ("add add add", 0)}))
    searcher = Searcher.of(indexer.store)
    queries = spark.createDataFrame([(7, "How TO  add numbers", 1), (8, "class Box:", 2)], "query_id bigint, text string, k int")
    rows = {(r["query_id"], r["rank"]): r["path"] for r in searcher.search(queries).collect()}
    assert set(rows) == {(7, 1), (8, 1), (8, 2)} and rows[7, 1] == "c.md"
    best = searcher.search(queries.drop("k"), k=1, scorer=jaccard).collect()
    assert {r["query_id"]: r["path"] for r in best}[7] == "c.md"


# --- requests --------------------------------------------------------------

REQUESTS = [
    '{"type": "context", "query": "add numbers"}',
    '{"type": "search", "query": "add numbers", "k": 1}',
    '{"type": "context", "query": "add numbers", "stream": true}',
    '{"type": "search", "query": "add numbers", "stream": true}',
    '{"type": "unknown"}',
    '{"query": "x"}',
    '{"type": "search", "query": 5}',
    '{"type": "search", "query": "x", "k": null}',
    '{"type": "search", "query": "x", "max_tokens": {}}',
    "not json",
    "[1]",
    "   ",
    '{"type": "context", "query": "add", "k": "2", "max_tokens": 3.0, "metadata_filter": {"kind": "class"}}',
    '{"type": "context", "query": "add", "metadata_filter": {"type": {"$gt": 5}}}',
]


def replies(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["line_no"], r["seq"])):
        out.setdefault(r["line_no"], []).append(json.loads(r["reply"]))
    return out


def check_replies(got):
    assert got[0][0]["status"] == "ok" and "File: c.md" in got[0][0]["data"]["content"]
    assert len(got[0][0]["data"]["metadata"]) == 4 and len(got[1][0]["data"]["metadata"]) == 1
    assert [e["event"] for e in got[2]] == ["chunk"] * 4 + ["end"]
    assert got[2][-1]["data"]["tokens"] == got[0][0]["data"]["tokens"]
    assert len(got[3]) == 1 and got[3][0]["status"] == "ok"
    messages = {n: r[0].get("message") for n, r in got.items()}
    assert messages[4] == "Unknown request type 'unknown'" and messages[5] == "Unknown request type 'None'"
    assert messages[6] == "Missing or invalid 'query' field"
    assert messages[7] == "Invalid 'k' field" and messages[8] == "Invalid 'max_tokens' field"
    assert messages[9] == "JSON decode error" and messages[10] == "Request is not a JSON object"
    assert 11 not in got
    assert got[12][0]["data"] == {"content": "", "metadata": [{"path": "b.py", "type": "class", "name": "Box", "start_line": 1, "end_line": 3}], "tokens": 0}
    assert got[13][0]["data"] == {"content": "", "metadata": [], "tokens": 0}


def test_replies_batch_and_stream(spark, indexer, tmp_path):
    indexer.index_full(files(spark, FIRST))
    searcher = Searcher.of(indexer.store)
    lines = spark.createDataFrame(list(enumerate(REQUESTS)), "line_no bigint, value string")
    check_replies(replies(searcher.replies(lines).collect()))
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    for part in (lines.where("line_no < 7"), lines.where("line_no >= 7")):
        part.write.mode("append").parquet(drop)
        stream = spark.readStream.schema(lines.schema).parquet(drop)
        jobs.answer_requests(stream, searcher, out, str(tmp_path / "cp"), once=True).awaitTermination()
    check_replies(replies(spark.read.parquet(out).collect()))


def test_request_files_to_reply_lines(spark, indexer, tmp_path):
    indexer.index_full(files(spark, FIRST))
    searcher = Searcher.of(indexer.store)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "requests.jsonl").write_text("\n".join(REQUESTS[:6] + ['{"type": "search", "query": "ü"}']))
    requests.write_replies(searcher.replies(requests.read_requests(spark, str(tmp_path / "in"))), str(tmp_path / "replies"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "replies")).collect()]
    assert [line.get("event", line.get("status")) for line in lines] == ["ok", "ok"] + ["chunk"] * 4 + ["end", "ok", "error", "error", "ok"]
    stream = requests.stream_requests(spark, str(tmp_path / "in"))
    jobs.answer_requests(stream, searcher, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(lines)


# --- watch mode ------------------------------------------------------------


def test_watch_equals_batch_and_replay_adds_nothing(spark, indexer, tmp_path):
    drop, checkpoint = str(tmp_path / "drop"), str(tmp_path / "cp")
    second = {**SECOND, "c.md": (None, 1)}
    for versions in (FIRST, second):
        files(spark, versions).coalesce(1).write.mode("append").parquet(drop)
        stream = spark.readStream.schema(FILES).parquet(drop)
        jobs.watch_files(stream, indexer, checkpoint, once=True).awaitTermination()
    assert snapshot(indexer.store.vectors()) == snapshot(indexer.store.chunks()) == AFTER
    again = spark.readStream.schema(FILES).parquet(drop)
    jobs.watch_files(again, indexer, checkpoint + "2", once=True).awaitTermination()
    assert snapshot(indexer.store.vectors()) == AFTER


# --- keyed tables, logs ----------------------------------------------------


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "key string, v int, what string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 4, "w"), ("c", 1, "n")], "key string, v int, what string")
    rows = {r["key"]: r["what"] for r in tables.upsert(old, new, ["key"]).collect()}
    assert rows == {"a": "z", "b": "w", "c": "n"}
    rows = {r["key"]: r["what"] for r in tables.upsert(old, new, ["key"], ["v"]).collect()}
    assert rows == {"a": "z", "b": "y", "c": "n"}


def test_fixed_batches_on_a_hot_key(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("key"), "id")
    got = tables.fixed_batches(rows, "key", "id", 32, fan_out=16).collect()
    for key, size in (("hot", 900), ("cold", 100)):
        numbers = sorted(r["row_no"] for r in got if r["key"] == key)
        assert numbers == list(range(size))
    assert all(r["batch_no"] == r["row_no"] // 32 for r in got)


def test_mean_pool(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "k string, embedding array<float>")
    assert {r["k"]: r["embedding"] for r in embedding.mean_pool(rows, "k").collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}


def test_cache_misses_are_distinct(spark):
    chunks = spark.createDataFrame([("a", CODE_MODEL), ("a", CODE_MODEL), ("b", CODE_MODEL)], "text string, model string")
    known = embedding.with_cache_key(chunks.where("text = 'b'")).select("key")
    assert [r["text"] for r in embedding.cache_misses(chunks, known).collect()] == ["a"]


def test_sixty_first_request_is_refused(spark):
    log = spark.range(61).select("id", F.lit("ip").alias("key"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)") * 0.5)).alias("ts"))
    refused = [r["id"] for r in logs.admit(log).where("not admitted").collect()]
    assert refused == [60]
    audit = logs.request_rate(log).first()
    assert audit["requests"] == 61 and audit["over_limit"]


def test_equal_times_are_admitted_by_id(spark):
    log = spark.range(5).select("id", F.lit(1).alias("key"), F.lit(T0).alias("ts"))
    got = {r["id"]: r["admitted"] for r in logs.admit(log, limit=3).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_late_feedback_is_dropped(spark, tmp_path):
    schema = "query_id bigint, chunk_id bigint, signal int, ts timestamp"
    drop, out, checkpoint = (str(tmp_path / n) for n in ("drop", "out", "cp"))
    for rows in ([(1, 1, 1, 0), (1, 1, -1, 0), (9, 9, 0, 10)], [(1, 1, 1, 0), (9, 9, 0, 20)]):
        made = spark.createDataFrame([(q, c, s, T0 + dt.timedelta(hours=h)) for q, c, s, h in rows], schema)
        made.coalesce(1).write.mode("append").parquet(drop)
        stream = jobs.feedback_stream(spark.readStream.schema(schema).parquet(drop))
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    rows = [tuple(r)[1:] for r in spark.read.parquet(out).where("query_id = 1").collect()]
    assert rows == [(1, 1, 1, 1, 2)]


def test_a_file_that_cannot_be_read_keeps_its_chunks(spark, indexer, tmp_path, monkeypatch):
    project = tmp_path / "project"
    project.mkdir()
    for name in ("a.md", "b.md"):
        (project / name).write_text(f"first text of {name}")
    indexer.refresh(str(project))
    later = (project / "a.md").stat().st_mtime + 5
    for name in ("a.md", "b.md"):
        (project / name).write_text(f"second text of {name}")
        os.utime(project / name, (later, later))
    real = indexer_module.read_contents

    def failing(listing):
        rows, bad = real(listing), F.col("path").endswith("a.md")
        return rows.withColumn("content", F.when(~bad, F.col("content"))).withColumn("error", F.when(bad, "OSError: no"))

    monkeypatch.setattr(indexer_module, "read_contents", failing)
    report = indexer.refresh(str(project))
    assert report["deleted"] == 0
    assert sorted(r.text for r in indexer.store.chunks().select("text").collect()) == ["first text of a.md", "second text of b.md"]
    monkeypatch.setattr(indexer_module, "read_contents", real)
    runs = len(indexer.store.commits())
    assert indexer.refresh(str(project))["chunks"] == 1
    assert indexer.refresh(str(project))["chunks"] == 0 and len(indexer.store.commits()) == runs + 1


def test_nothing_is_deleted_after_a_listing_with_errors(spark, indexer, tmp_path, monkeypatch):
    project = tmp_path / "project"
    project.mkdir()
    (project / "a.md").write_text("a text")
    (project / "b.md").write_text("another text")
    indexer.refresh(str(project))
    (project / "b.md").unlink()
    real = indexer_module.unlisted
    monkeypatch.setattr(indexer_module, "unlisted", lambda spark, root: spark.createDataFrame([(root + "/closed",)], "path string"))
    assert indexer.refresh(str(project))["deleted"] == 0 and indexer.store.chunks().count() == 2
    with pytest.raises(OSError):
        indexer.refresh(str(project), suppress_errors=False)
    monkeypatch.setattr(indexer_module, "unlisted", real)
    assert indexer.refresh(str(project))["deleted"] == 1 and indexer.store.chunks().count() == 1


def test_rerank_keeps_each_querys_own_k(spark, indexer):
    indexer.index_full(files(spark, {f"{i}.md": (f"thread {i} of the loom", 0) for i in range(70)}))
    queries = spark.createDataFrame([(1, "thread of the loom", 60), (2, "loom", 2)], "query_id bigint, text string, k int")
    hits = Searcher.of(indexer.store).hits(queries, scorer=jaccard, candidates=5)
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 60, 2: 2}


def test_filters_of_queries_and_of_the_whole_search_agree(spark, indexer):
    kinds = {"a.py": "def f():\n    return 1\n", "b.js": "function g() {\n  return 2;\n}\n", "c.md": "plain words"}
    indexer.index_full(files(spark, {name: (text, 0) for name, text in kinds.items()}))
    searcher = Searcher.of(indexer.store)
    for where in ({"lang": {"$ne": "python"}}, {"lang": {"$nin": ["javascript"]}}, {"lang": None}, {"model": {"$ne": None}},
                  {"space": "text"}, {"tokens": {"$lt": 3}}, {"$and": [{}]}, {"$or": [{}, {"lang": "python"}]}, {"lang": {"$in": ["python", None]}}):
        own = spark.createDataFrame([(0, "f", json.dumps(where))], "query_id bigint, text string, where string")
        whole = sorted(r.chunk_id for r in searcher.hits("f", 10, where).collect())
        assert sorted(r.chunk_id for r in searcher.hits(own, 10).collect()) == whole, where
    lines = spark.createDataFrame([(1, json.dumps({"type": "context", "query": "f", "metadata_filter": {"nothing": 1}}))], "line_no bigint, value string")
    assert json.loads(searcher.replies(lines).first().reply) == {"status": "error", "message": "Invalid 'metadata_filter' field"}
