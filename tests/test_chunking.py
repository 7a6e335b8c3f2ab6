import pytest
from pyspark.errors import PySparkException

from loomdex.operators import chunking
from loomdex.operators.chunking import brace_spans


def chunks_of(spark, path, content):
    rows = chunking.chunk_files(spark.createDataFrame([(path, content)], "path string, content string")).collect()
    return sorted((r["start_line"], r["type"], r["name"], r["end_line"], r["text"]) for r in rows)


def names(rows):
    return [(r[1], r[2], r[0], r[3]) for r in rows]


def test_python_class_and_function_but_no_method(spark):
    code = "class Loom:\n    width = 3\n\n    def weave(self, n):\n        return n * self.width\n\n\ndef spin(*threads, twist=2):\n    return [t * twist for t in threads]\n"
    rows = chunks_of(spark, "fake.py", code)
    assert names(rows) == [("class", "Loom", 1, 5), ("function", "spin", 8, 9)]
    assert rows[1][4] == "def spin(*threads, twist=2):\n    return [t * twist for t in threads]"


def test_python_nesting(spark):
    code = (
        "@deco\n"
        "async def outer():\n"
        "    def inner():\n"
        "        pass\n"
        "    class Local:\n"
        "        def m(self):\n"
        "            class Deep: pass\n"
        "class A:\n"
        "    class B:\n"
        "        x = 1\n"
        "    def m(self):\n"
        "        def hidden(): pass\n"
        "if True:\n"
        "    def guarded(): pass\n"
    )
    assert names(chunks_of(spark, "n.py", code)) == [
        ("function", "outer", 2, 7),
        ("function", "inner", 3, 4),
        ("class", "Local", 5, 7),
        ("class", "A", 8, 12),
        ("class", "B", 9, 10),
        ("function", "guarded", 14, 14),
    ]


def test_line_ends_and_unicode(spark):
    rows = chunks_of(spark, "u.py", "# ünïcode\r\ndef f():\r\n    return 'é'\r\n")
    assert rows == [(2, "function", "f", 3, "def f():\n    return 'é'")]


@pytest.mark.parametrize(
    "path,content,expected",
    [
        ("a/notes.md", "one\ntwo\n", (1, "file", "notes.md", 2, "one\ntwo\n")),
        ("a/empty.py", "", (1, "file", "empty.py", 0, "")),
        ("a/broken.py", "def f(:\n", (1, "file", "broken.py", 1, "def f(:\n")),
        ("a/plain.py", "x = 1", (1, "file", "plain.py", 1, "x = 1")),
        ("a/plain.js", "let x = 1;\n\n", (1, "file", "plain.js", 2, "let x = 1;\n\n")),
        ("a/UPPER.PY", "def f(): pass", (1, "file", "UPPER.PY", 1, "def f(): pass")),
    ],
)
def test_whole_file_fallback(spark, path, content, expected):
    assert chunks_of(spark, path, content) == [expected]


def test_javascript(spark):
    code = """// function no() {
export async function add(a, b = {x: "}"}) {
  if (a) { return helper(b); }
  const s = `}`;
}
export default class Box extends Base {
  constructor(x) { super(x); }
  get size() {
    while (true) { break; }
  }
  static async *walk(items) {
    for (const i of items) { yield i; }
  }
}
const o = {
  run() { return 1; },
};
const f = function hidden() { return 2; };
"""
    assert names(chunks_of(spark, "x.js", code)) == [
        ("function_declaration", "add", 2, 5),
        ("class_declaration", "Box", 6, 14),
        ("method_definition", "constructor", 7, 7),
        ("method_definition", "size", 8, 10),
        ("method_definition", "walk", 11, 13),
        ("method_definition", "run", 16, 16),
    ]


def test_typescript(spark):
    code = """class Repo {
  private find<T>(id: number): Promise<T> {
    return this.get({ id });
  }
}
function over(a: string): void {
  /* } */
}
"""
    assert names(chunks_of(spark, "x.TS", code)) == [
        ("class_declaration", "Repo", 1, 5),
        ("method_definition", "find", 2, 4),
        ("function_declaration", "over", 6, 8),
    ]


def test_go(spark):
    code = """package main

func Add(a int, b interface{}) int {
	return a // }
}

func (s *Server) Close() error { return nil }

type T struct {
	x int
}

func Map[K any](m map[K]struct{}) {
}
"""
    assert names(chunks_of(spark, "x.go", code)) == [
        ("function_declaration", "Add", 3, 5),
        ("method_declaration", "Close", 7, 7),
        ("function_declaration", "Map", 13, 14),
    ]


def test_java(spark):
    code = """public class Shop {
  private int n = 0;
  public Shop(int n) { this.n = n; }
  @Override
  public List<String> names(Map<String, Integer> m) throws IOException {
    if (n > 0) { return other(m); }
    else if (n < 0) { n++; }
    return new ArrayList<>();
  }
  abstract int size();
  class Inner {
    void go() {}
  }
}
"""
    assert names(chunks_of(spark, "Shop.java", code)) == [
        ("class_declaration", "Shop", 1, 14),
        ("method_declaration", "names", 4, 9),
        ("method_declaration", "size", 10, 10),
        ("class_declaration", "Inner", 11, 13),
        ("method_declaration", "go", 12, 12),
    ]


def test_added_language(spark):
    rust = [("function_item", r"^[ \t]*(?P<at>(?:pub\s+)?fn\s+(?P<name>\w+))")]
    languages = chunking.BUILT_IN.having(".rs", "rust", rust)
    files = spark.createDataFrame([("m.rs", "pub fn go() {\n}\nfn other() { }\n")], "path string, content string")
    rows = chunking.chunk_files(files, languages=languages).orderBy("start_line").collect()
    assert [(r["lang"], r["type"], r["kind"], r["name"], r["end_line"]) for r in rows] == [
        ("rust", "function_item", "function", "go", 2), ("rust", "function_item", "function", "other", 3)
    ]


def test_parse_errors_reported_or_raised(spark):
    files = spark.createDataFrame([("ok.py", "x = 1"), ("bad.py", "def (")], "path string, content string")
    assert [r["path"] for r in chunking.parse_failures(files).collect()] == ["bad.py"]
    with pytest.raises(PySparkException, match="bad.py"):
        chunking.parse_failures(files, suppress_errors=False).collect()


def test_ids_are_stable_and_distinct(spark):
    code = "def f():\n    pass\n\ndef f():\n    pass\n"
    files = spark.createDataFrame([("a.py", code), ("b.py", code)], "path string, content string")
    first, second = ({r["chunk_id"] for r in chunking.chunk_files(files).collect()} for _ in range(2))
    assert first == second and len(first) == 4


def test_outermost_and_depth_with_small_blocks(spark):
    rows = [("p", f"c{i}", s, e) for i, (s, e) in enumerate([(1, 50), (2, 10), (11, 60), (51, 60), (61, 61), (3, 4), (61, 61)])]
    rows += [("q", "c9", 5, 9)]
    chunks = spark.createDataFrame(rows, "path string, chunk_id string, start_line int, end_line int")
    for block in (3, 4096):
        kept = {r["chunk_id"] for r in chunking.outermost(chunks, block).collect()}
        assert kept == {"c0", "c2", "c4", "c9"}
    source = "a {\n b { '}' }\n} // {\n{\n"
    files = spark.createDataFrame([("f", source)], "path string, content string")
    for block in (2, 4096):
        depths = {r["line_no"]: r["depth"] for r in chunking.brace_depth(files, block).collect()}
        assert depths == {1: 1, 2: 1, 3: 0, 4: 1}


def test_brace_shapes_that_hide_braces():
    java = (
        "class Loom {\n  @Get\n  public String find(@Param(\"q\") String q, int n) {\n    String t = \"\"\"\n  } { \"x\"\n\"\"\";\n"
        "    return q;\n  }\n  int two() { return 2; }\n}\n"
    )
    assert brace_spans(java, "java") == [
        ("class_declaration", "Loom", 1, 10), ("method_declaration", "find", 2, 8),
        ("method_declaration", "two", 9, 9)]
    script = "function open(x) {\n  return /{/.test(x);\n}\nconst r = a / b / c;\nfunction shut() {\n  return 1\n}\n"
    assert brace_spans(script, "javascript") == [("function_declaration", "open", 1, 3), ("function_declaration", "shut", 5, 7)]
    typed = (
        "function f(): { a: number } {\n  return {a: 1};\n}\nclass K {\n  m(): Promise<{ b: string }> {\n    return go();\n  }\n"
        "  n(): number { return 1 }\n}\n"
    )
    assert brace_spans(typed, "typescript") == [
        ("function_declaration", "f", 1, 3), ("class_declaration", "K", 4, 9), ("method_definition", "m", 5, 7),
        ("method_definition", "n", 8, 8)]


def test_unbalanced_braces_give_the_whole_file(spark):
    rows = chunks_of(spark, "x.js", "function cut() {\n  if (a) {\n}\nlast();\n")
    assert len(rows) == 1 and "last();" in rows[0][4]
