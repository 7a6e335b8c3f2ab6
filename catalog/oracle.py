"""The same results in DuckDB SQL, written from the definitions, not from the Spark code."""

from __future__ import annotations

FILES = """files AS (
  SELECT doc_id,
    CASE WHEN doc_id % 13 = 0 THEN 'build/' WHEN doc_id % 19 = 0 THEN 'pkg/venv/' ELSE '' END
      || source || '/' || lang || '/' || doc_id || '.'
      || CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'go' WHEN 3 THEN 'md' WHEN 4 THEN 'txt' ELSE 'json' END AS path,
    CASE WHEN doc_id % 17 = 0 THEN chr(0) ELSE '' END || text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 SECOND AS mtime
  FROM documents)"""
LANG = "CASE suffix WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.go' THEN 'go' END"
IS_CODE = "regexp_matches(path, '\\.(py|js|go|json)$')"
LINES = "len(regexp_split_to_array({0}, '\\r\\n|\\n|\\r')) - CASE WHEN regexp_matches({0}, '(^|\\n|\\r)$') THEN 1 ELSE 0 END"
TOKENS = "len(regexp_extract_all({0}, '\\S+'))"
NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"

STATE = """state AS (
  SELECT f.path, CASE WHEN l.quality = 1 THEN f.mtime - INTERVAL 1 HOUR ELSE f.mtime END AS mtime
  FROM files f JOIN labels l USING (doc_id))"""

# All files as whole-file chunks (prose has no declarations).
FILE_CHUNKS = f"""fchunks AS (
  SELECT doc_id, path, 'file' AS type, 'file' AS kind, regexp_extract(path, '[^/]+$') AS name, 1 AS start_line,
    CAST({LINES.format('content')} AS INTEGER) AS end_line, content AS text, {TOKENS.format('content')} AS tokens,
    CASE WHEN {IS_CODE} THEN 'code' ELSE 'text' END AS space,
    {LANG.replace('suffix', "regexp_extract(path, '[.][a-z]+$')")} AS lang, mtime
  FROM files)"""

VCHUNKS = f"""vchunks AS (
  SELECT vec_id AS chunk_id, CASE WHEN vec_id % 2 = 1 THEN 'text' ELSE 'code' END AS space, label,
    CASE WHEN label <= 4 THEN 'function' WHEN label <= 7 THEN 'class' ELSE 'file' END AS kind,
    'c_' || vec_id AS name, 'v/c_' || vec_id || '.py' AS path,
    CAST(vec_id + 1 AS INTEGER) AS start_line, CAST(vec_id + 10 AS INTEGER) AS end_line,
    CAST(embedding AS DOUBLE[]) AS v, d.text AS text, {TOKENS.format("coalesce(d.text, '')")} AS tokens
  FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id)"""


def vectors(name: str, source: str) -> str:
    """CTEs giving ``name(id, v, n)``: hashed token counts of ``source(id, text)`` and their norm."""
    return f"""{name}_tokens AS (
  SELECT id, CAST('0x' || md5(t)[1:8] AS BIGINT) % 64 AS b, count(*) AS c
  FROM (SELECT id, unnest(regexp_extract_all(text, '\\S+')) AS t FROM {source}) GROUP BY ALL),
{name}_lists AS (
  SELECT s.id, list(CAST(coalesce(c, 0) AS DOUBLE) ORDER BY r.b) AS v
  FROM {source} s CROSS JOIN (SELECT unnest(range(64)) AS b) r LEFT JOIN {name}_tokens t ON t.id = s.id AND t.b = r.b GROUP BY s.id),
{name} AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM {name}_lists)"""


def distance(a: str, b: str) -> str:
    return f"CASE WHEN {a}.n = 0 OR {b}.n = 0 THEN 1.0 ELSE 1.0 - list_dot_product({a}.v, {b}.v) / ({a}.n * {b}.n) END"


EMB = "emb AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM vchunks)"

VPAIRS = f"""{VCHUNKS}, {EMB},
pairs AS (
  SELECT q.chunk_id AS query_id, c.chunk_id, c.space, c.kind, c.label, {distance('q', 'c')} AS distance
  FROM emb q JOIN emb c ON q.chunk_id <> c.chunk_id)"""


def top(source: str, k, by: str = "query_id", rank: str = "rank") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY distance, chunk_id) AS {rank} "
        f"FROM {source}) WHERE {rank} <= {k}"
    )


HEADER = (
    "'File: ' || path || ', Type: ' || type || ', Name: ' || name || ', Lines: ' || start_line || '-' || end_line "
    "|| chr(10) || text || chr(10)"
)



TEXT_QUERIES = """tq AS (
  SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT -item_id - 1, text FROM benchmark)"""


DOC_PACKED = f"""{TEXT_QUERIES}, nq AS (SELECT id, {NORMAL.format('text')} AS text FROM tq), dt AS (SELECT doc_id AS id, text FROM documents),
{vectors('qv', 'nq')}, {vectors('dv', 'dt')},
pairs AS (SELECT q.id AS query_id, c.id AS chunk_id, {distance('q', 'c')} AS distance FROM qv q CROSS JOIN dv c),
hits AS ({top('pairs', 5)}),
packed AS (
  SELECT h.*, 'v/c_' || doc_id || '.py' AS path, CASE WHEN doc_id % 10 <= 4 THEN 'function' WHEN doc_id % 10 <= 7 THEN 'class' ELSE 'file' END AS type,
    'c_' || doc_id AS name, CAST(doc_id + 1 AS INTEGER) AS start_line, CAST(doc_id + 10 AS INTEGER) AS end_line, text, {TOKENS.format('text')} AS tokens,
    sum({TOKENS.format('text')}) OVER (PARTITION BY query_id ORDER BY rank) AS cum
  FROM hits h JOIN documents ON doc_id = chunk_id),
fit AS (SELECT *, cum <= 1500 AS packed FROM packed)"""


def contexts(queries: str, packed: str) -> str:
    return f"""SELECT q.id AS query_id, md5(coalesce(content, '')) AS content_md5, length(coalesce(content, '')) AS chars,
  coalesce(hits, 0) AS hits, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens
FROM {queries} q LEFT JOIN (
  SELECT query_id, string_agg(CASE WHEN packed THEN {HEADER} END, chr(10) ORDER BY rank) AS content,
    count(*) AS hits, sum(CASE WHEN packed THEN tokens END) AS tokens
  FROM {packed} GROUP BY query_id) a ON a.query_id = q.id"""


# Documents kept by the default ignore rules and the binary test, as an index.
KEPT = """kept AS (
  SELECT *, sha256(concat_ws('|', path, 'file', name, '1', text)) AS chunk_id FROM fchunks
  WHERE doc_id % 13 <> 0 AND doc_id % 19 <> 0 AND doc_id % 17 <> 0)"""
NORMAL_QUERIES = f"{TEXT_QUERIES}, nq AS (SELECT id, {NORMAL.format('text')} AS text FROM tq)"
TEXT_INDEX = f"""{FILES}, {FILE_CHUNKS}, {KEPT}, ktexts AS (SELECT chunk_id AS id, text FROM kept),
{vectors('kv', 'ktexts')}"""

# Requests by construction: the last digit of the line number tells the shape.
REQUESTS = f"""{TEXT_QUERIES}, req AS (
  SELECT id AS line_no, abs(id) % 10 AS shape, regexp_replace(text, '[\\x00-\\x1f"\\\\]', ' ', 'g') AS query FROM tq),
checked AS (
  SELECT line_no, shape,
    CASE WHEN shape IN (0, 2, 4, 7) THEN 'context' WHEN shape IN (1, 5) THEN 'search' WHEN shape = 3 THEN 'delete' END AS type,
    CASE WHEN shape IN (0, 1, 2, 3, 5, 7) THEN query END AS query,
    CASE shape WHEN 1 THEN 3 WHEN 7 THEN 2 WHEN 5 THEN NULL ELSE 5 END::BIGINT AS k,
    CASE shape WHEN 2 THEN 600 ELSE 8000 END::BIGINT AS max_tokens, shape = 2 AS stream,
    CASE shape WHEN 7 THEN '{{"lang":"go"}}' END AS where_,
    CASE shape WHEN 3 THEN 'Unknown request type ''delete''' WHEN 4 THEN 'Missing or invalid ''query'' field'
      WHEN 5 THEN 'Invalid ''k'' field' WHEN 6 THEN 'JSON decode error' WHEN 9 THEN 'Request is not a JSON object' END AS message
  FROM req WHERE shape <> 8)"""

REPLIES = f"""WITH {TEXT_INDEX}, {REQUESTS},
good AS (SELECT * FROM checked WHERE message IS NULL),
gq AS (SELECT line_no AS id, {NORMAL.format('query')} AS text FROM good),
{vectors('qv', 'gq')},
gpairs AS (
  SELECT g.line_no AS query_id, kept.*, g.k, g.max_tokens, {distance('q', 'c')} AS distance
  FROM good g JOIN qv q ON q.id = g.line_no JOIN kv c ON true JOIN kept ON kept.chunk_id = c.id
  WHERE g.where_ IS NULL OR kept.lang = 'go'),
ghits AS ({top('gpairs', 'k')}),
gfit AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM ghits),
packed AS (SELECT *, cum <= max_tokens AS packed FROM gfit),
answers AS ({contexts('gq', 'packed')})
SELECT line_no, 1 AS seq, 'error' AS status, NULL::VARCHAR AS event, message, NULL::VARCHAR AS content_md5, NULL::BIGINT AS tokens
FROM checked WHERE message IS NOT NULL
UNION ALL SELECT line_no, 1, 'ok', NULL, NULL, content_md5, tokens FROM good JOIN answers ON query_id = line_no WHERE NOT stream
UNION ALL SELECT query_id, CAST(rank AS INTEGER), NULL, 'chunk', NULL, md5(text), NULL
FROM packed JOIN good ON query_id = line_no WHERE stream AND packed
UNION ALL SELECT line_no, CAST(1 + count(query_id) AS INTEGER), NULL, 'end', NULL, NULL, CAST(coalesce(max(cum), 0) AS BIGINT)
FROM good LEFT JOIN (SELECT * FROM packed WHERE packed) p ON p.query_id = line_no WHERE stream GROUP BY line_no"""


def module_cte(source: str, key: str, group: str) -> str:
    """Position of each declaration in its generated file."""
    return (
        f"(SELECT *, {group} || '/m' || CAST(floor({key} / 1000.0) AS BIGINT) AS file, "
        f"row_number() OVER (PARTITION BY {group}, floor({key} / 1000.0) ORDER BY {key}) AS i, "
        f"count(*) OVER (PARTITION BY {group}, floor({key} / 1000.0)) AS total FROM {source})"
    )


PARTS, SUPPLIERS = module_cte("part", "p_partkey", "p_brand"), module_cte("supplier", "s_suppkey", "s_nationkey")


def span(path, lang, type_, kind, name, start, end, text_, source):
    return (
        f"SELECT {path} AS path, '{lang}' AS lang, 'code' AS space, '{type_}' AS type, '{kind}' AS kind, {name} AS name, "
        f"CAST({start} AS INTEGER) AS start_line, CAST({end} AS INTEGER) AS end_line, {text_} AS text FROM {source}"
    )


PY_CHUNKS = " UNION ALL ".join([
    span("'src/py/' || file || '.py'", "python", "function", "function", "'fn_' || p_partkey", "3 * i - 2", "3 * i - 1",
         "'def fn_' || p_partkey || E'(x):\\n    return ' || p_size", PARTS),
    span("'src/pyc/' || file || '.py'", "python", "class", "class", "'S_' || s_suppkey", "4 * i - 3", "4 * i - 1",
         "'class S_' || s_suppkey || E':\\n    def m(self):\\n        return 1'", SUPPLIERS),
])
GO_TEXT = "'func F_' || p_partkey || E'(a int) int {\\n\\treturn ' || p_size || E' // }\\n}'"
JAVA_METHOD = "'  int m_' || p_partkey || E'(int a) {\\n    return ' || p_size || E';\\n  }'"
BRACE_CHUNKS = " UNION ALL ".join([
    span("'src/js/' || file || '.js'", "javascript", "function_declaration", "function", "'f_' || p_partkey", "6 * i - 5", "6 * i",
         "'function f_' || p_partkey || E'(a) {\\n  if (a) {\\n    return ' || p_size || E';\\n  }\\n  return 0;\\n}'", PARTS),
    span("'src/jsc/' || file || '.js'", "javascript", "class_declaration", "class", "'K_' || s_suppkey", "5 * i - 4", "5 * i",
         "'class K_' || s_suppkey || E' {\\n  m_' || s_suppkey || E'() {\\n    return 1;\\n  }\\n}'", SUPPLIERS),
    span("'src/jsc/' || file || '.js'", "javascript", "method_definition", "function", "'m_' || s_suppkey", "5 * i - 3", "5 * i - 1",
         "'  m_' || s_suppkey || E'() {\\n    return 1;\\n  }'", SUPPLIERS),
    span("'src/go/' || file || '.go'", "go", "function_declaration", "function", "'F_' || p_partkey", "3 * i", "3 * i + 2", GO_TEXT, PARTS),
    span("'src/java/' || file || '.java'", "java", "method_declaration", "function", "'m_' || p_partkey", "3 * i - 1", "3 * i + 1", JAVA_METHOD, PARTS),
    span("'src/java/' || file || '.java'", "java", "class_declaration", "class", "'C'", "1", "3 * n + 2",
         "E'class C {\\n' || body || E'\\n}'",
         f"(SELECT file, count(*) AS n, string_agg({JAVA_METHOD}, chr(10) ORDER BY i) AS body FROM {PARTS} GROUP BY file)"),
    span("'src/ts/' || file || '.ts'", "typescript", "function_declaration", "function", "'t_' || p_partkey", "6 * i - 3", "6 * i",
         "'export function t_' || p_partkey || E'(a: number): string {\\n  const r = /[{]/.test(\"}\");\\n  return `x${a > ' || p_size "
         "|| E' ? `{${a}` : \"}\"} {`;\\n}'", PARTS),
    span("'src/javat/' || file || '.java'", "java", "class_declaration", "class", "'T_' || s_suppkey", "8 * i - 7", "8 * i",
         "'class T_' || s_suppkey || E' {\\n  String s = \"\"\"\\n    { \"\\n    \"\"\";\\n  int n_' || s_suppkey "
         "|| E'() {\\n    return 1; /* } */\\n  }\\n}'", SUPPLIERS),
    span("'src/javat/' || file || '.java'", "java", "method_declaration", "function", "'n_' || s_suppkey", "8 * i - 3", "8 * i - 1",
         "'  int n_' || s_suppkey || E'() {\\n    return 1; /* } */\\n  }'", SUPPLIERS),
])

# What an incremental run leaves of the files, and BM25 of the text queries over it.
LIVE = """live AS (SELECT f.*, sha256(concat_ws('|', path, 'file', name, '1', text)) AS chunk_id
  FROM fchunks f LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)"""
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def bm25(queries: str, k: int) -> str:
    return f"""lw AS (SELECT chunk_id, {WORDS.format('text')} AS t FROM live),
ltf AS (SELECT chunk_id, len(t) AS dl, w AS term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS w FROM lw) GROUP BY ALL),
ls AS (SELECT count(*) AS n, avg(len(t)) AS al FROM lw),
ldf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM ltf, ls GROUP BY term, n),
qw AS (SELECT DISTINCT id, unnest({WORDS.format('text')}) AS term FROM {queries}),
bm AS (
  SELECT id AS query_id, chunk_id, round(sum(w * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))), 6) AS score
  FROM qw JOIN ldf USING (term) JOIN ltf USING (term), ls GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= {k})"""


CACHED = "cached AS (SELECT md5(text || '-codebert-base') AS key, max(doc_id) AS version FROM documents SEMI JOIN labels USING (doc_id) GROUP BY ALL)"
FEEDBACK = "SELECT user_id AS query_id, event_id % 50 AS chunk_id, count(*) FILTER (event_type IN ('purchase', 'click')) AS positive, count(*) FILTER (event_type = 'error') AS negative, count(*) AS total FROM events GROUP BY ALL"
RATE = "SELECT user_id AS key, date_trunc('day', ts) AS window_start, count(*) AS requests, count(*) > 5 AS over_limit FROM events GROUP BY ALL"
ADMIT = """SELECT event_id AS id, user_id AS key, date_trunc('day', ts) AS window_start,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 5 AS admitted FROM events"""

ORACLE = {
    "scan_suffix_filter": f"""WITH {FILES}, s AS (SELECT path, regexp_extract(path, '[.][a-z]+$') AS suffix FROM files)
SELECT path, regexp_replace(path, '^build/', '') AS rel_path, suffix, regexp_extract(path, '[^/]+$') AS file_name, {LANG} AS lang
FROM s WHERE suffix IN ('.py', '.js', '.go')""",
    "ignore_rules": f"""WITH {FILES}, rules AS (SELECT * FROM (VALUES
  (1, '(^|/)[^/]*\\.json(/|$)', false), (2, '^src3/(.*/)?[^/]*\\.json(/|$)', true), (3, '^src4/de(/|$)', false),
  (4, '^src[5-7]/[^/]*/[^/]*\\.tx[^/](/|$)', false), (5, '(^|/)build/', true), (6, '(^|/)venv/', false),
  (7, '(^|/)__pycache__/', false), (8, '(^|/)migrations/', false), (9, '(^|/)\\.git/', false), (10, '(^|/)\\.pytest_cache/', false),
  (11, '\\.pyc(/|$)', false), (12, '\\.pyo(/|$)', false), (13, '\\.pyd(/|$)', false), (14, '(^|/)\\.env(/|$)', false),
  (15, '(^|/)dist/', false), (16, '(^|/)build/', false)) t(no, regex, negated)),
m AS (SELECT path, arg_max(negated, no) AS negated FROM files JOIN rules ON regexp_matches(path, regex) GROUP BY path)
SELECT path, coalesce(NOT negated, false) AS ignored FROM files LEFT JOIN m USING (path)""",
    "text_sniff": f"""WITH {FILES} SELECT path, md5(content) AS text_md5, length(content) AS chars FROM files
WHERE NOT contains(content, chr(0))""",
    "bad_files": "SELECT 'src/s' || s_suppkey || '.py' AS path, 'SyntaxError' AS error FROM supplier WHERE s_acctbal < 0",
    "file_lookup": f"""WITH {FILES}, r AS (SELECT doc_id AS request_id, 'src' || doc_id % 20 || '/en/' || doc_id || '.js' AS path FROM labels)
SELECT request_id, path, CASE WHEN content IS NULL THEN 'not_found' ELSE 'success' END AS status,
  CASE WHEN content IS NOT NULL THEN 'codebase' END AS source, md5(content) AS content_md5, {TOKENS.format('content')} AS tokens
FROM r LEFT JOIN files USING (path)""",
    "file_route_code_text": f"""WITH {FILES} SELECT path, CASE WHEN {IS_CODE} THEN 'codebert-base' ELSE 'all-MiniLM-L6-v2' END AS model,
  CASE WHEN {IS_CODE} THEN 'code' ELSE 'text' END AS space FROM files""",
    "file_chunks_fallback": f"""WITH {FILES}, {FILE_CHUNKS}
SELECT path, type, kind, name, start_line, end_line, md5(text) AS text_md5, tokens FROM fchunks""",
    "python_chunks": PY_CHUNKS,
    "brace_chunks": BRACE_CHUNKS,
    "brace_depth": f"""SELECT 'src/js/' || file || '.js' AS path, 6 * i - 5 + o AS line_no, [1, 2, 2, 1, 1, 0][o + 1]::BIGINT AS depth
FROM {PARTS} CROSS JOIN (SELECT unnest(range(6)) AS o)
UNION ALL SELECT 'src/jsc/' || file || '.js', 5 * i - 4 + o, [1, 2, 2, 1, 0][o + 1]::BIGINT
FROM {SUPPLIERS} CROSS JOIN (SELECT unnest(range(5)) AS o)
UNION ALL SELECT 'src/ts/' || file || '.ts', 6 * i - 5 + o, [0, 0, 1, 1, 1, 0][o + 1]::BIGINT
FROM {PARTS} CROSS JOIN (SELECT unnest(range(6)) AS o)
UNION ALL SELECT 'src/javat/' || file || '.java', 8 * i - 7 + o, [1, 1, 1, 1, 2, 2, 1, 0][o + 1]::BIGINT
FROM {SUPPLIERS} CROSS JOIN (SELECT unnest(range(8)) AS o)
UNION ALL SELECT 'src/go/' || file || '.go', 3 * i + o, [1, 1, 0][o + 1]::BIGINT FROM {PARTS} CROSS JOIN (SELECT unnest(range(3)) AS o)
UNION ALL SELECT DISTINCT 'src/go/' || file || '.go', unnest([1, 2]), 0 FROM {PARTS}
UNION ALL SELECT 'src/java/' || file || '.java', 3 * i - 1 + o, [2, 2, 1][o + 1]::BIGINT FROM {PARTS} CROSS JOIN (SELECT unnest(range(3)) AS o)
UNION ALL SELECT DISTINCT 'src/java/' || file || '.java', 1, 1 FROM {PARTS}
UNION ALL SELECT DISTINCT 'src/java/' || file || '.java', 3 * total + 2, 0 FROM {PARTS}""",
    "chunk_ids": f"SELECT path, name, sha256(concat_ws('|', path, type, name, start_line, text)) AS chunk_id FROM ({PY_CHUNKS})",
    "outermost_chunks": f"""WITH c AS ({BRACE_CHUNKS})
SELECT path, type, name, start_line, end_line FROM c b WHERE NOT EXISTS (
  SELECT 1 FROM c a WHERE a.path = b.path AND (a.start_line, a.end_line) <> (b.start_line, b.end_line)
    AND a.start_line <= b.start_line AND a.end_line >= b.end_line)""",
    "changed_files": f"""WITH {FILES}, {STATE} SELECT path, f.mtime FROM files f LEFT JOIN state s USING (path)
WHERE s.mtime IS NULL OR f.mtime > s.mtime""",
    "file_state_upsert": f"WITH {FILES}, {STATE} SELECT path, greatest(f.mtime, coalesce(s.mtime, f.mtime)) AS mtime FROM files f LEFT JOIN state s USING (path)",
    "index_replace_deleted": f"""WITH {FILES} SELECT path, CASE WHEN quality = 1 THEN 'new' ELSE 'old' END AS origin
FROM files LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0""",
    "embed_cache_misses": f"""WITH {CACHED} SELECT DISTINCT md5(text || '-codebert-base') AS key, 'codebert-base' AS model, length(text) AS chars
FROM documents WHERE md5(text || '-codebert-base') NOT IN (SELECT key FROM cached)""",
    "embed_cache_upsert": "SELECT md5(text || '-codebert-base') AS key, max(doc_id) AS version FROM documents GROUP BY ALL",
    "hashed_embedding": """SELECT doc_id, CAST('0x' || md5(t)[1:8] AS BIGINT) % 64 AS bucket, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS t FROM documents) GROUP BY ALL""",
    "mean_pooling": """SELECT label, pos, round(avg(x), 6) AS mean FROM (
  SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL""",
    "batch_rows": """SELECT lang, doc_id, row_no, row_no // 32 AS batch_no FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS row_no FROM documents)""",
    "index_counts": f"""WITH {VCHUNKS} SELECT coalesce(space, 'all') AS space, count(*) AS chunks, count(DISTINCT path) AS files
FROM vchunks GROUP BY ROLLUP (space)""",
    "stale_versions": f"""WITH {VCHUNKS}, i AS (
  SELECT chunk_id, space, CASE WHEN quality = 1 THEN '2025-06-02' WHEN quality IS NOT NULL THEN '2025-01-15' END AS index_version
  FROM vchunks LEFT JOIN labels ON doc_id = chunk_id)
SELECT * FROM i WHERE index_version IS NULL OR index_version < '2025-06-02'""",
    "index_full": f"""WITH {TEXT_INDEX} SELECT chunk_id, path, space, CASE space WHEN 'code' THEN 'codebert-base' ELSE 'all-MiniLM-L6-v2' END AS model,
  end_line, tokens, round(n, 6) AS norm FROM kept JOIN kv ON kv.id = kept.chunk_id""",
    "run_metrics": """SELECT 1 AS run, true AS "full", count(*) AS files, 0::BIGINT AS deleted, count(*) AS chunks
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
UNION ALL SELECT 2, false, count(*) FILTER (coalesce(toxic, 0) = 0), count(*) FILTER (toxic = 1 AND quality IS NOT NULL), count(*) FILTER (coalesce(toxic, 0) = 0)
FROM documents LEFT JOIN labels USING (doc_id)""",
    "knn_exact": f"WITH {VPAIRS} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM ({top('pairs', 5)})",
    "knn_ann_trained": f"WITH {VPAIRS} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM ({top('pairs', 5)})",
    "knn_ann_recall": f"WITH {TEXT_QUERIES} SELECT count(*) AS queries, true AS recall_reached FROM tq",
    "knn_tiled": f"WITH {VPAIRS} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM ({top('pairs', 5)})",
    "knn_ann_after_update": f"""WITH {FILES}, {FILE_CHUNKS}, {NORMAL_QUERIES},
{LIVE}, lt AS (SELECT chunk_id AS id, text FROM live), {vectors('lv', 'lt')}, {vectors('qv', 'nq')},
p AS (SELECT q.id AS query_id, live.chunk_id, space, {distance('q', 'c')} AS distance FROM qv q CROSS JOIN lv c JOIN live ON live.chunk_id = c.id)
SELECT query_id, chunk_id, space, round(distance, 6) AS distance, rank FROM ({top('p', 5)})""",
    "knn_filtered": f"""WITH {VPAIRS}, f AS (SELECT * FROM pairs WHERE (kind = 'class' OR label >= 8) AND space <> 'text')
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM ({top('f', 10)})""",
    "knn_two_spaces": f"""WITH {VPAIRS}, s AS ({top('pairs', 5, 'query_id, space', 'space_rank')})
SELECT query_id, chunk_id, space, round(distance, 6) AS distance, space_rank, rank FROM ({top('s', 5)})""",
    "knn_ann": f"""WITH {VPAIRS}, centres AS (SELECT CAST(chunk_id AS VARCHAR) AS cell, v, n FROM emb ORDER BY md5(CAST(chunk_id AS VARCHAR)) LIMIT 16),
placed AS (
  SELECT e.chunk_id, c.cell, row_number() OVER (PARTITION BY e.chunk_id ORDER BY {distance('e', 'c')}, c.cell) AS place
  FROM emb e CROSS JOIN centres c),
sizes AS (SELECT cell, count(*) AS size FROM placed WHERE place = 1 GROUP BY cell),
probes AS (
  SELECT chunk_id AS query_id, cell, place,
    coalesce(sum(size) OVER (PARTITION BY chunk_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
  FROM placed LEFT JOIN sizes USING (cell)),
near AS (
  SELECT p.* FROM pairs p JOIN placed h ON h.chunk_id = p.chunk_id AND h.place = 1
  JOIN probes b ON b.query_id = p.query_id AND b.cell = h.cell WHERE b.place <= 4 OR b.held < 6)
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM ({top('near', 5)})""",
    "rerank_lexical": f"""WITH {NORMAL_QUERIES}, dt AS (SELECT doc_id AS id, text FROM documents),
{vectors('qv', 'nq')}, {vectors('dv', 'dt')},
p AS (SELECT q.id AS query_id, c.id AS chunk_id, {distance('q', 'c')} AS distance FROM qv q CROSS JOIN dv c),
h AS ({top('p', 20, rank='first_rank')}),
words AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS w FROM tq),
dwords AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS w FROM dt),
scored AS (
  SELECT h.*, coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0.0) AS score
  FROM h JOIN words a ON a.id = query_id JOIN dwords b ON b.id = chunk_id)
SELECT query_id, chunk_id, round(distance, 6) AS distance, first_rank, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) AS rank FROM scored) WHERE rank <= 5""",
    "lexical_bm25": f"WITH {FILES}, {FILE_CHUNKS}, {TEXT_QUERIES}, {LIVE}, {bm25('tq', 10)} SELECT query_id, chunk_id, score, rank FROM best",
    "hybrid_search": f"""WITH {FILES}, {FILE_CHUNKS}, {NORMAL_QUERIES}, {LIVE}, {bm25('nq', 20)},
lt AS (SELECT chunk_id AS id, text FROM live), {vectors('lv', 'lt')}, {vectors('qv', 'nq')},
p AS (SELECT q.id AS query_id, c.id AS chunk_id, {distance('q', 'c')} AS distance FROM qv q CROSS JOIN lv c),
hits AS ({top('p', 20)}),
both_lists AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM hits UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM best),
fusion AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM both_lists GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fusion) WHERE rank <= 5""",
    "semantic_dedup": f"""WITH dt AS (SELECT doc_id AS id, text FROM documents), {vectors('dv', 'dt')}
SELECT b.id AS chunk_id, min(a.id) AS duplicate_of FROM dv a JOIN dv b ON a.id < b.id AND a.n > 0 AND b.n > 0
WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98 GROUP BY b.id""",
    "context_for_query": f"WITH {DOC_PACKED} {contexts('tq', 'fit')}",
    "search_results": f"""WITH {DOC_PACKED} SELECT query_id, rank, chunk_id, round(distance, 6) AS distance, path, type, name, start_line, end_line,
  md5(text) AS text_md5, tokens, CAST(cum AS BIGINT) AS cum, packed FROM fit""",
    "stream_events": f"""WITH {DOC_PACKED}, p AS (SELECT * FROM fit WHERE packed)
SELECT query_id, CAST(rank AS INTEGER) AS seq, 'chunk' AS event, md5(text) AS content_md5, path, NULL::BIGINT AS tokens FROM p
UNION ALL SELECT tq.id, CAST(1 + count(p.query_id) AS INTEGER), 'end', NULL, NULL, CAST(coalesce(max(cum), 0) AS BIGINT)
FROM tq LEFT JOIN p ON p.query_id = tq.id GROUP BY tq.id""",
    "context_for_text": f"""WITH {TEXT_INDEX}, {NORMAL_QUERIES}, {vectors('qv', 'nq')},
p AS (SELECT q.id AS query_id, kept.*, {distance('q', 'c')} AS distance FROM qv q CROSS JOIN kv c JOIN kept ON kept.chunk_id = c.id),
h AS ({top('p', 5)}),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) <= 1500 AS packed FROM h) {contexts('tq', 'f')}""",
    "query_normalise": f"WITH {NORMAL_QUERIES} SELECT id AS query_id, text AS query FROM nq",
    "request_validation": f"""WITH {REQUESTS} SELECT line_no, type, md5(query) AS query_md5, k, max_tokens, stream, where_ AS "where", message FROM checked""",
    "request_replies": REPLIES,
    "request_stream": REPLIES,
    "event_parse": """WITH e AS (
  SELECT conv_id, turn, role, text, regexp_replace(text, '\\s+', ' ', 'g') AS flat,
    list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM conversations)
SELECT conv_id, turn,
  CASE role WHEN 'user' THEN 'chunk' WHEN 'assistant' THEN 'end' ELSE CASE WHEN starts_with(lines[1], 'data:') THEN 'note' ELSE 'raw' END END AS event,
  md5(CASE role WHEN 'user' THEN '{"turn":' || turn || '}' WHEN 'assistant' THEN trim(flat)
    ELSE CASE WHEN starts_with(lines[1], 'data:') THEN trim(lines[1][6:]) ELSE E'event: note\\n' || text END END) AS data_md5 FROM e""",
    "rate_limit_audit": RATE,
    "rate_limit_stream": RATE,
    "rate_limit_admit": ADMIT,
    "rate_limit_live": ADMIT,
    "feedback_counts": FEEDBACK,
    "feedback_stream": FEEDBACK,
    "watch_incremental": f"""WITH {FILES}, {FILE_CHUNKS}
SELECT path, space, end_line, md5(text) AS text_md5, tokens, mtime FROM fchunks LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0""",
}
