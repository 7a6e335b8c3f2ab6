"""Files to chunks: classes and functions where they can be found, else the file.

A file is one row and its chunks depend on nothing else, so the work is a map
without a shuffle: a small pandas helper finds the spans, Spark cuts the text.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions import paths
from loomdex.functions.constants import CODE_MODEL, CODE_SUFFIXES, LANGUAGE_OF_SUFFIX, TEXT_MODEL
from loomdex.functions.text import chunk_id, count_tokens, let, slice_lines, split_lines
from loomdex.operators.lexer import code_only
from loomdex.operators.running import running

SPAN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)
SPANS = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("error", T.StringType())])


# --- Python ---------------------------------------------------------------


def python_spans(source: str):
    """Classes, and functions outside classes, with their line ranges."""
    spans = []

    def collect(node, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                spans.append(("class", child.name, child.lineno, child.end_lineno))
                collect(child, True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if not in_class:  # methods, and all inside them, belong to the class chunk
                    spans.append(("function", child.name, child.lineno, child.end_lineno))
                    collect(child, False)
            else:
                collect(child, in_class)

    collect(ast.parse(source), False)
    return spans


# --- brace languages ------------------------------------------------------

GO_EMPTY_TYPE = re.compile(r"\b(?:interface|struct)\s*\{\s*\}")
AT_STATEMENT = r"(?:^|(?<=[;{}]))[ \t]*(?:export\s+)?(?:default\s+)?"
NOT_A_NAME = r"(?!(?:if|for|while|switch|catch|with|return|function|new|do|else|try|throw|await|typeof|super|synchronized)\b)"
NOT_A_MODIFIER = r"(?!(?:public|protected|private|static|final|abstract|native|strictfp|default)\b)"
JAVA_MODIFIERS = (
    r"(?:@[\w.]+(?:\([^()]*\))?\s+)*"
    r"(?:(?:public|protected|private|static|final|abstract|native|synchronized|strictfp|default)\s+)*"
)

# a type that may stand between parameters and body: names with arguments and object types, joined by | and &
TYPE_PART = r"(?:\{[^{}]*\}|[\w$.]+(?:<(?:[^<>{};]|\{[^{}]*\}|<[^<>]*>)*>)?)(?:\[\])*"
RETURN_TYPE = rf"\s*:\s*(?:[\w$.]+\s+is\s+)?{TYPE_PART}(?:\s*[|&]\s*{TYPE_PART})*\s*(?=\{{)"

SCRIPT_HEADERS = [
    ("function_declaration", AT_STATEMENT + r"(?P<at>(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^()]*>)?\s*\()"),
    ("class_declaration", AT_STATEMENT + r"(?P<at>class\s+(?P<name>[\w$]+))"),
    (
        "method_definition",
        r"(?:^|(?<=[;{},]))[ \t]*(?P<at>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?:\*[ \t]*)?"
        + NOT_A_NAME
        + r"(?P<name>#?[\w$]+)\s*(?:<[^(){};]*>)?\((?:[^(){};]|\([^()]*\)|\{[^{}]*\})*\)(?:" + RETURN_TYPE + r"|\s*(?=\{)))",
    ),
]
HEADERS = {
    "javascript": SCRIPT_HEADERS,
    "typescript": SCRIPT_HEADERS,
    "go": [
        ("function_declaration", r"^(?P<at>func\s+(?P<name>\w+)\s*[\[(])"),
        ("method_declaration", r"^(?P<at>func\s*\([^()]*\)\s*(?P<name>\w+)\s*\()"),
    ],
    "java": [
        ("class_declaration", r"^[ \t]*(?P<at>" + JAVA_MODIFIERS + r"class\s+(?P<name>\w+))"),
        (
            "method_declaration",
            r"(?:^|(?<=[;{}]))[ \t]*(?P<at>" + JAVA_MODIFIERS + r"(?:<[^(){};]*>\s*)?"
            + NOT_A_NAME + NOT_A_MODIFIER
            + r"[\w.]+(?:<[^(){};]*>)?(?:\[\])*\s+(?P<name>\w+)\s*\((?:[^(){};]|\([^(){};]*\))*\)\s*(?:throws[\s\w.,]+)?(?=[{;]))",
        ),
    ],
}


def blank(match):
    return re.sub(r"[^\n]", " ", match.group())


def brace_spans(source: str, language: str, headers: dict = HEADERS):
    """Declarations of ``language`` in source order, ends found by matching braces.

    Raises where the body of a declaration has no end: the file is then better
    one chunk than cut short.
    """
    text = code_only(source, "javascript" if headers[language] is SCRIPT_HEADERS else language)
    if language == "go":
        text = GO_EMPTY_TYPE.sub(blank, text)
    closing, open_at = {}, []
    for brace in re.finditer(r"[{}]", text):
        if brace.group() == "{":
            open_at.append(brace.start())
        elif open_at:
            closing[open_at.pop()] = brace.start()
    found = {}
    for kind, header in headers[language]:
        for match in re.finditer(header, text, re.M):
            found.setdefault(match.start("at"), (kind, match))
    newlines = [m.start() for m in re.finditer("\n", text)]

    def line(position):
        return bisect_left(newlines, position) + 1

    spans = []
    for start, (kind, match) in sorted(found.items()):
        body = re.compile(r"[{;]" if language == "java" else r"\{").search(text, body_from(text, match))
        if body is not None and body.group() == "{" and body.start() not in closing:
            raise ValueError(f"no end of {match['name']}, line {line(start)}")
        end = len(text) - 1 if body is None else closing.get(body.start(), body.start())
        spans.append((kind, match["name"], line(start), line(end)))
    return spans


def body_from(text: str, match) -> int:
    """Where to look for the body: past the parameter list if the header stops inside it."""
    depth, position = match.group().count("(") - match.group().count(")"), match.end()
    while depth > 0 and position < len(text):
        depth += {"(": 1, ")": -1}.get(text[position], 0)
        position += 1
    typed = re.compile(RETURN_TYPE).match(text, position)
    return typed.end() if typed else position


# --- the job --------------------------------------------------------------


@dataclass(frozen=True)
class Languages:
    """What can be split: suffix to language, and the declaration headers of each language.

    A header is (node type, regex with groups ``at`` for its start and ``name``).
    """

    of_suffix: dict
    headers: dict

    def having(self, suffix: str, language: str, headers: list) -> Languages:
        """These languages and one more."""
        return Languages({**self.of_suffix, suffix: language}, {**self.headers, language: headers})


BUILT_IN = Languages(LANGUAGE_OF_SUFFIX, HEADERS)


def span_finder(headers: dict):
    """Pandas UDF (content, language) to spans; null content costs nothing."""

    def one(source, lang):
        if source is None:
            return [], None
        try:
            spans = python_spans(source) if lang == "python" else brace_spans(source, lang, headers)
            return [dict(zip(SPAN.names, span)) for span in spans], None
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            return [], f"{type(error).__name__}: {error}"

    def find_spans(content: pd.Series, language: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s, l) for s, l in zip(content, language)], columns=["spans", "error"])

    return F.pandas_udf(find_spans, SPANS)


def language(path: Column, languages: Languages = BUILT_IN) -> Column:
    """Language whose declarations can be split, else null; '.py' must match in case."""
    lookup = F.create_map(*[F.lit(v) for pair in languages.of_suffix.items() for v in pair])
    suffix = paths.suffix(path)
    return F.when(suffix == ".py", "python").otherwise(F.try_element_at(lookup, F.lower(suffix)))


def model(path: Column) -> Column:
    """Embedding model by suffix: listed code suffixes, else prose."""
    return F.when(F.lower(paths.suffix(path)).isin(*CODE_SUFFIXES), CODE_MODEL).otherwise(TEXT_MODEL)


def space(model: Column) -> Column:
    """Vector space of a model; a chunk without one is code."""
    return F.when(F.coalesce(model, F.lit(CODE_MODEL)) == CODE_MODEL, "code").otherwise("text")


def kind(type: Column) -> Column:
    """function | class | file, whatever the language calls the node."""
    return (
        F.when(type.startswith("class"), "class")
        .when(type == "file", "file")
        .otherwise("function")
    )


def with_spans(files: DataFrame, languages: Languages = BUILT_IN) -> DataFrame:
    """Add ``lang``, ``spans`` and the parser's ``error``."""
    find_spans = span_finder(languages.headers)
    return (
        files.withColumn("lang", language(F.col("path"), languages))
        .withColumn("_found", find_spans(F.when(F.col("lang").isNotNull(), F.col("content")), F.col("lang")))
        .select(*files.columns, "lang", "_found.spans", "_found.error")
    )


def chunk_files(files: DataFrame, count_tokens=count_tokens, languages: Languages = BUILT_IN) -> DataFrame:
    """All chunks of ``files(path, content, ...)``, other columns carried along."""
    carried = [c for c in files.columns if c not in ("path", "content")]
    type_, name, start, end, text = "type", "name", "start_line", "end_line", "text"

    def whole_file(lines):
        return F.array(
            F.struct(
                F.lit("file").alias(type_),
                paths.file_name(F.col("path")).alias(name),
                F.lit(1).alias(start),
                F.size(lines).alias(end),
                F.col("content").alias(text),
            )
        )

    def cut(lines):
        return F.transform(
            "spans",
            lambda s: F.struct(
                s[type_].alias(type_),
                s[name].alias(name),
                s[start].alias(start),
                s[end].alias(end),
                slice_lines(lines, s[start], s[end]).alias(text),
            ),
        )

    chunks = let(
        split_lines(F.col("content")),
        lambda lines: F.when(F.size("spans") == 0, whole_file(lines)).otherwise(cut(lines)),
    )
    model_ = model(F.col("path"))
    return (
        with_spans(files, languages)
        .select("path", "lang", *carried, F.explode(chunks).alias("c"))
        .select("path", "lang", *carried, "c.*")
        .select(
            chunk_id("path", type_, name, start, text).alias("chunk_id"),
            "path",
            space(model_).alias("space"),
            "lang",
            type_,
            kind(F.col(type_)).alias("kind"),
            name,
            start,
            end,
            text,
            count_tokens(F.col(text)).alias("tokens"),
            model_.alias("model"),
            *carried,
        )
    )


def parse_failures(files: DataFrame, suppress_errors: bool = True) -> DataFrame:
    """Files whose declarations could not be parsed (they become file chunks); strict raises."""
    failed = with_spans(files).where("error is not null").select("path", "error")
    if suppress_errors:
        return failed
    return failed.select("path", F.raise_error(F.concat("path", F.lit(": "), "error")).alias("error"))


# --- operators over chunk and line tables ---------------------------------


def outermost(chunks: DataFrame, lines_per_block: int = 4096) -> DataFrame:
    """Chunks no other chunk of their file contains.

    In order of (start, longest first), a chunk is inside another one exactly
    when some earlier end reaches its own end: a running maximum, not a self join.
    """
    order = ["start_line", F.desc("end_line"), "chunk_id"]
    reach = running(
        chunks, ["path"], F.floor(F.col("start_line") / lines_per_block), order,
        F.col("end_line"), "max", "_reach", include_row=False,
    )
    return reach.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end_line"))).drop("_reach")


@F.pandas_udf(T.StringType())
def code_of(content: pd.Series, language: pd.Series) -> pd.Series:
    """Sources with comments, strings, templates and regular expressions blanked."""
    return pd.Series([None if source is None else code_only(source, name) for source, name in zip(content, language)], dtype=object)


def brace_depth(files: DataFrame, lines_per_block: int = 4096, languages: Languages = BUILT_IN) -> DataFrame:
    """``path, line_no, depth``: depth of braces in code after each line of each file.

    Comments, strings, templates and regular expressions of any number of lines do not count.
    """
    code = code_of("content", language(F.col("path"), languages))
    lines = files.select("path", F.posexplode(split_lines(code)).alias("pos", "line")).select(
        "path",
        (F.col("pos") + 1).alias("line_no"),
        (F.regexp_count("line", F.lit("\\{")) - F.regexp_count("line", F.lit("\\}"))).cast("long").alias("step"),
    )
    block = F.floor(F.col("line_no") / lines_per_block)
    return running(lines, ["path"], block, ["line_no"], F.col("step"), "sum", "depth").select(
        "path", "line_no", F.col("depth").cast("long").alias("depth")
    )
