"""Inputs of the query catalogue: plain projections and small groupings of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import count_tokens
from loomdex.functions.vectors import hashed_vector

PER_FILE = 1000  # key range of one generated source file, so that a file stays small at any scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark, sf) -> DataFrame:
    """Documents as files: six suffixes, some in ignored folders, some with a NUL in front."""
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("py", "js", "go", "md", "txt", "json")]), (d % 6 + 1).cast("int"))
    folder = F.when(d % 13 == 0, "build/").when(d % 19 == 0, "pkg/venv/").otherwise("")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(folder, "source", F.lit("/"), "lang", F.lit("/"), d.cast("string"), F.lit("."), ext).alias("path"),
        F.concat(F.when(d % 17 == 0, F.lit("\x00")).otherwise(""), "text").alias("content"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=d.cast("decimal(18,6)"))).alias("mtime"),
    )


def doc_state(spark, sf) -> DataFrame:
    """What an earlier run knew: labelled documents, seen an hour ago where quality is 1."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    hour = F.make_dt_interval(hours=F.lit(1))
    return doc_files(spark, sf).join(labels, "doc_id").select(
        "path", F.when(F.col("quality") == 1, F.col("mtime") - hour).otherwise(F.col("mtime")).alias("mtime")
    )


def module_files(rows: DataFrame, key: str, group, folder: str, ext: str, line, head="", tail="") -> DataFrame:
    """One source file per (group, range of ``PER_FILE`` keys), declarations by key."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    files = rows.groupBy(group.alias("g"), F.floor(F.col(key) / PER_FILE).alias("m")).agg(parts.alias("parts"))
    path = F.concat(F.lit(folder + "/"), F.col("g").cast("string"), F.lit("/m"), F.col("m").cast("string"), F.lit(ext))
    body = F.array_join(F.transform("parts", lambda p: p["line"]), "")
    return files.select(path.alias("path"), F.concat(F.lit(head), body, F.lit(tail)).alias("content"))


def fmt(template: str, *columns) -> F.Column:
    return F.format_string(template, *columns)


def py_sources(spark, sf) -> DataFrame:
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    function = fmt("def fn_%d(x):\n    return %d\n\n", "p_partkey", "p_size")
    klass = fmt("class S_%d:\n    def m(self):\n        return 1\n\n", "s_suppkey")
    return module_files(part, "p_partkey", F.col("p_brand"), "src/py", ".py", function).unionByName(
        module_files(supplier, "s_suppkey", F.col("s_nationkey"), "src/pyc", ".py", klass)
    )


def brace_sources(spark, sf) -> DataFrame:
    """JavaScript, TypeScript, Go and Java files; braces hide in comments, text blocks, templates and regular expressions."""
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    js = fmt("function f_%d(a) {\n  if (a) {\n    return %d;\n  }\n  return 0;\n}\n", "p_partkey", "p_size")
    klass = fmt("class K_%1$d {\n  m_%1$d() {\n    return 1;\n  }\n}\n", "s_suppkey")
    go = fmt("func F_%d(a int) int {\n\treturn %d // }\n}\n", "p_partkey", "p_size")
    java = fmt("  int m_%d(int a) {\n    return %d;\n  }\n", "p_partkey", "p_size")
    ts = fmt(
        "/* t_%1$d {\n   { */\nexport function t_%1$d(a: number): string {\n  const r = /[{]/.test(\"}\");\n"
        "  return `x${a > %2$d ? `{${a}` : \"}\"} {`;\n}\n", "p_partkey", "p_size")
    block = fmt(
        'class T_%1$d {\n  String s = """\n    { "\n    """;\n  int n_%1$d() {\n    return 1; /* } */\n  }\n}\n', "s_suppkey")
    brand = F.col("p_brand")
    return (
        module_files(part, "p_partkey", brand, "src/js", ".js", js)
        .unionByName(module_files(supplier, "s_suppkey", F.col("s_nationkey"), "src/jsc", ".js", klass))
        .unionByName(module_files(part, "p_partkey", brand, "src/go", ".go", go, "package p\n\n"))
        .unionByName(module_files(part, "p_partkey", brand, "src/java", ".java", java, "class C {\n", "}\n"))
        .unionByName(module_files(part, "p_partkey", brand, "src/ts", ".ts", ts))
        .unionByName(module_files(supplier, "s_suppkey", F.col("s_nationkey"), "src/javat", ".java", block))
    )


def broken_py_sources(spark, sf) -> DataFrame:
    """Python files; those of suppliers in debt lack a closing bracket."""
    supplier = table(spark, sf, "supplier")
    return supplier.select(
        F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("def f():\n    return (1"), F.when(F.col("s_acctbal") < 0, "").otherwise(")"), F.lit("\n")).alias("content"),
    )


def bare_vectors(spark, sf) -> DataFrame:
    """Embeddings as an index without texts."""
    label = F.col("label")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.when(F.col("vec_id") % 2 == 1, "text").otherwise("code").alias("space"),
        F.when(label <= 4, "function").when(label <= 7, "class").otherwise("file").alias("kind"),
        F.concat(F.lit("c_"), F.col("vec_id").cast("string")).alias("name"),
        (F.col("vec_id") + 1).cast("int").alias("start_line"),
        (F.col("vec_id") + 10).cast("int").alias("end_line"),
        "label",
        "embedding",
    )


def vector_chunks(spark, sf) -> DataFrame:
    """The same index with the document of the same id as text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return (
        bare_vectors(spark, sf)
        .join(docs, "chunk_id", "left")
        .withColumn("type", F.col("kind"))
        .withColumn("path", F.concat(F.lit("v/"), "name", F.lit(".py")))
        .withColumn("tokens", count_tokens(F.coalesce("text", F.lit(""))))
    )


def vector_queries(spark, sf) -> DataFrame:
    """Every vector is a query too; its own row is left out of its hits."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def text_queries(spark, sf) -> DataFrame:
    """What users asked in conversations, and the benchmark texts."""
    turns = table(spark, sf, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    items = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("query_id"), "text")
    return turns.unionByName(items)


def doc_vectors(spark, sf) -> DataFrame:
    """Documents with hashed vectors, one space."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit("text").alias("space"), "text", hashed_vector(F.col("text")).alias("embedding")
    )


def doc_index(spark, sf) -> DataFrame:
    """Every document as a chunk with metadata and its hashed vector."""
    digit = F.col("chunk_id") % 10
    return doc_vectors(spark, sf).withColumns({
        "kind": F.when(digit <= 4, "function").when(digit <= 7, "class").otherwise("file"),
        "type": F.when(digit <= 4, "function").when(digit <= 7, "class").otherwise("file"),
        "name": F.concat(F.lit("c_"), F.col("chunk_id").cast("string")),
        "path": F.concat(F.lit("v/c_"), F.col("chunk_id").cast("string"), F.lit(".py")),
        "start_line": (F.col("chunk_id") + 1).cast("int"),
        "end_line": (F.col("chunk_id") + 10).cast("int"),
        "tokens": count_tokens(F.col("text")),
    })


def request_lines(spark, sf) -> DataFrame:
    """Request lines of all sorts, good and bad, around the text queries."""
    q = F.col("query_id")
    text = F.regexp_replace(F.col("text"), '[\\x00-\\x1f"\\\\]', " ")
    shapes = {
        0: '{"type":"context","query":"%s"}',
        1: '{"type":"search","query":"%s","k":3}',
        2: '{"type":"context","query":"%s","stream":true,"max_tokens":600}',
        3: '{"type":"delete","query":"%s"}',
        4: '{"type":"context","question":"%s"}',
        5: '{"type":"search","query":"%s","k":"many"}',
        6: '{"type":"context","query":"%s"',
        7: '{"type":"context","query":"%s","k":"2","metadata_filter":{"lang":"go"}}',
        8: "  ",
        9: '["context","%s"]',
    }
    value = F.lit("")
    for n, shape in shapes.items():
        head, _, tail = shape.partition("%s")
        made = F.concat(F.lit(head), text, F.lit(tail)) if "%s" in shape else F.lit(shape)
        value = F.when(F.abs(q) % 10 == n, made).otherwise(value)
    return text_queries(spark, sf).select(q.alias("line_no"), value.alias("value"))


def request_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")


def feedback(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        (F.col("event_id") % 50).alias("chunk_id"),
        F.when(kind.isin("purchase", "click"), 1).when(kind == "error", -1).otherwise(0).alias("signal"),
        "ts",
    )
