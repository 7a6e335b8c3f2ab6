import hashlib
import os
import re

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomdex.functions import paths, vectors
from loomdex.functions.text import count_tokens, normalise_query
from loomdex.functions.vectors import hashed_vector
from loomdex.operators.filters import metadata_filter
from loomdex.sources import project


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.py": b"def a(): pass\n",
        "pkg/__init__.py": b"x = 1\n",
        "pkg/_b.py": b"y = 2\n",
        "pkg/d.py": b"z = 3\n",
        ".env.js": b"let x = 1;\n",
        "pkg/.hid/c.py": b"w = 4\n",
        "bin.py": b"\x00\x01",
        "late_nul.txt": b"a" * 3000 + b"\x00",
        "bad_utf8.txt": b"caf\xe9\n",
        "venv/lib/x.py": b"no\n",
        "deep/build/y.py": b"no\n",
        ".env": b"no\n",
        "skip/me.log": b"no\n",
        "skip/keep.log": b"yes\n",
        ".gitignore": b"# rules\n\n*.log\n!keep.log\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path


def relative(rows, folder):
    return sorted(os.path.relpath(r["path"], folder) for r in rows)


def test_scan_sees_hidden_names_and_obeys_rules(spark, folder):
    rows = project.scan_project(spark, str(folder)).collect()
    assert relative(rows, folder) == sorted(
        ["a.py", "pkg/__init__.py", "pkg/_b.py", "pkg/d.py", ".env.js", "pkg/.hid/c.py", "late_nul.txt",
         "bad_utf8.txt", "skip/keep.log", ".gitignore"]
    )
    text = {os.path.basename(r["path"]): r["content"] for r in rows}
    assert text["bad_utf8.txt"] == "caf\ufffd\n"
    assert len(text["late_nul.txt"]) == 3001
    stat = os.stat(folder / "a.py").st_mtime
    mtime = {os.path.basename(r["path"]): r["mtime"] for r in rows}["a.py"]
    assert abs(mtime.timestamp() - stat) < 1e-3


@pytest.mark.parametrize("suffixes,expected", [(".py", 5), ([".py", ".js", "y"], 6), ([], 0)])
def test_suffixes_are_a_set(spark, folder, suffixes, expected):
    assert project.scan_project(spark, str(folder), suffixes).count() == expected


def test_deep_and_wide_folders_are_listed_once(spark, tmp_path):
    for i in range(30):
        d = tmp_path / f"d{i % 5}" / f"e{i}" / "f"
        d.mkdir(parents=True)
        (d / "x.py").write_text("x")
        (d.parent / "y.py").write_text("y")
    spark.dataSource.register(project.ProjectFiles)
    for split in (1, 4, 1000):
        listing = spark.read.format("project_files").option("minPartitions", split).load(str(tmp_path))
        assert listing.count() == listing.distinct().count() == 60


def test_unreadable_file(spark, folder):
    listing = project.list_files(spark, str(folder))
    gone = listing.withColumn("path", F.concat("path", F.lit(".gone"))).limit(1)
    read = project.read_contents(gone)
    assert read.first()["error"].startswith("FileNotFoundError")
    assert project.text_files(read).count() == 0
    with pytest.raises(PySparkException, match="FileNotFoundError"):
        project.text_files(read, suppress_errors=False).collect()


@pytest.mark.parametrize(
    "rule,hits,misses",
    [
        ("build/", ["build/a", "x/build/a"], ["build", "xbuild/a", "x/build"]),
        ("*.pyc", ["a.pyc", "x/b.pyc", "c.pyc/d"], ["a.py", "pyc"]),
        (".env", [".env", "x/.env", ".env/y"], [".env.js", "a.env"]),
        ("/top", ["top", "top/x"], ["a/top"]),
        ("doc/*.txt", ["doc/a.txt"], ["doc/b/a.txt", "x/doc/a.txt"]),
        ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["x/a/z"]),
        ("**/logs", ["logs", "x/logs", "x/y/logs/z"], ["xlogs"]),
        ("abc/**", ["abc/x", "abc/x/y"], ["abc"]),
        ("f[0-9].?s", ["f1.js", "d/f9.ts"], ["fa.js", "f1.jjs"]),
        ("f[!0-9]", ["fa"], ["f1"]),
        (r"\!odd", ["!odd"], ["odd"]),
    ],
)
def test_ignore_rules(spark, rule, hits, misses):
    rows = spark.createDataFrame([(p,) for p in hits + misses], "path string")
    ignored = {r["path"] for r in rows.where(paths.is_ignored(F.col("path"), [rule])).collect()}
    assert ignored == set(hits)


def test_last_rule_wins(spark):
    rows = spark.createDataFrame([("a.log",), ("keep.log",), ("build/keep.log",)], "path string")
    rules = ["*.log", "!keep.log", "!build/", "build/"]
    ignored = {r["path"] for r in rows.where(paths.is_ignored(F.col("path"), rules)).collect()}
    assert ignored == {"a.log", "build/keep.log"}


def test_get_files(spark):
    files = spark.createDataFrame([("a", "x y")], "path string, content string")
    asked = spark.createDataFrame([("a",), ("b",)], "path string")
    rows = {r["path"]: (r["status"], r["source"], r["tokens"]) for r in project.get_files(asked, files, count_tokens).collect()}
    assert rows == {"a": ("success", "codebase", 2), "b": ("not_found", None, None)}


def test_suffix_and_names(spark):
    rows = spark.createDataFrame([("a/b.tar.gz",), ("a/.env",), ("a.b/c",), ("x.PY",)], "p string")
    got = [tuple(r) for r in rows.select(paths.suffix(F.col("p")), paths.file_name(F.col("p"))).collect()]
    assert got == [(".gz", "b.tar.gz"), ("", ".env"), ("", "c"), (".PY", "x.PY")]


def test_normalise_like_split_and_join(spark):
    texts = ["  Hello\t WORLD \n", "a\u00a0b\u2003c", "", "x\x1cy"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalise_query(F.col("t"))).collect()
    assert [r[0] for r in rows] == [" ".join(t.lower().split()) for t in texts]


@pytest.mark.parametrize("width", [1, 2, 7, 64])
def test_hashed_vector_by_hand(spark, width):
    from hashlib import md5

    texts = ["", "a", "a b a c  d\n a", "é ü é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_vector(F.col("t"), width)).collect()
    for text, row in zip(texts, rows):
        expected = [0.0] * width
        for token in text.split():
            expected[int(md5(token.encode()).hexdigest()[:8], 16) % width] += 1
        assert row[0] == expected


@pytest.mark.parametrize(
    "where,expected",
    [
        ({}, "abc"),
        (None, "abc"),
        ({"type": "class"}, "a"),
        ({"type": {"$ne": "class"}, "n": {"$gte": 2}}, "bc"),
        ({"$or": [{"type": "class"}, {"n": {"$gt": 2}}]}, "ac"),
        ({"$and": [{"n": {"$in": [1, 2]}}, {"n": {"$nin": [1]}}]}, "b"),
        ({"n": {"$gt": 1, "$lt": 3}}, "b"),
        ({"n": {"$lte": 1}}, "a"),
    ],
)
def test_metadata_filter(spark, where, expected):
    df = spark.createDataFrame([("a", "class", 1), ("b", "function", 2), ("c", "file", 3)], "id string, type string, n int")
    assert "".join(sorted(r["id"] for r in metadata_filter(df, where).collect())) == expected


def test_unknown_filter_operator(spark):
    with pytest.raises(ValueError):
        metadata_filter(spark.range(1), {"$not": []})


def test_tokens_are_counted_in_batches_and_few_hashes_remembered(monkeypatch):
    monkeypatch.setattr(vectors, "REMEMBERED", 5)
    vectors.hashes.clear()
    texts = [b"a b\ta\nc\x0bd\x0ce\rf", None, b"", b" \n ", b"x\x00 \x1c y\xc2\xa0z " * 200, b"long" * 100, b"bad \xff \xed\xa0\x80"] * 30
    counts = vectors.token_counts(pa.array(texts, pa.binary()), 8).to_pylist()
    for text, row in zip(texts, counts):
        if text is None:
            assert row is None
            continue
        expected = [0.0] * 8
        for token in re.findall(rb"[^ \t\n\x0b\x0c\r]+", text.replace(b"\xff", b"\xef\xbf\xbd").replace(b"\xed\xa0\x80", b"\xef\xbf\xbd")):
            expected[int(hashlib.md5(token).hexdigest()[:8], 16) % 8] += 1
        assert row == expected
    assert len(vectors.hashes) <= 5 and max(map(len, vectors.hashes)) <= vectors.LONGEST
