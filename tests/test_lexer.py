"""What counts as code in brace languages."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomdex.operators import chunking
from loomdex.operators.lexer import code_only


def braces(source, language):
    return "".join(c for c in code_only(source, language) if c in "{}")


@pytest.mark.parametrize("language, source, kept", [
    ("javascript", "a /* { \n } */ { // }\n}", "{}"),
    ("javascript", "x = `a${b ? `{${c}}` : {k: 1}.k}{`; {", "{}{"),
    ("javascript", "f(`${ {a: `}`} }`) {}", "{}{}"),
    ("javascript", "r = /[}/{]\\/{/g.test(a) / b; { }", "{}"),
    ("javascript", "return /{/ ; a = b / c / {d: 1}", "{}"),
    ("javascript", "x = (a) / 2; y = a[1] / 3; '{\\'{' + \"}\\\"}\" {", "{"),
    ("javascript", "'open {\n} {", "}{"),
    ("javascript", "`never closed { ${x", ""),
    ("typescript", "class A<T> { m(): `a${string}` { return 1 } }", "{{}}"),
    ("java", 'String s = """\n { \\""" " } """; { char c = \'{\'; }', "{}"),
    ("java", "/* no end {", ""),
    ("go", "s := `raw \\` { x := \"{\\\"{\" }", "{}"),
    ("go", "r := '{' // {\n{", "{"),
])
def test_braces_that_count(language, source, kept):
    assert braces(source, language) == kept


@given(st.text("ab/*\"'`${}\\\n()=[]"), st.sampled_from(["javascript", "typescript", "go", "java", None]))
def test_any_text_keeps_its_length_and_lines(source, language):
    code = code_only(source, language)
    assert len(code) == len(source) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
    assert all(c in (" ", "\n", s) for c, s in zip(code, source))


def test_depth_over_lines_that_are_no_code(spark):
    source = "function f() {\n  /* {\n  { */ return `\n{${g({\n  a: 1})}\n`;\n}\n"
    files = spark.createDataFrame([("a.js", source), ("b.ts", None), ("c.java", "")], "path string, content string")
    rows = chunking.brace_depth(files, 2).where("path = 'a.js'").orderBy("line_no").collect()
    assert [r["depth"] for r in rows] == [1, 1, 1, 2, 1, 1, 0]


def test_declarations_inside_and_after_templates():
    source = "const t = `function no() { ${run(() => { return 1 })} }`;\nfunction yes() {\n  return `}`;\n}\n"
    assert chunking.brace_spans(source, "typescript") == [("function_declaration", "yes", 2, 4)]
