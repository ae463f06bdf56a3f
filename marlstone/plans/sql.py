"""DuckDB SQL of the registered queries: shared table expressions, then one statement a query."""

from __future__ import annotations

NOW = 1706745600
FOLD = "strip_accents(lower({}))"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"


def norm(x: str) -> str:
    return f"' ' || array_to_string({tokens(x)}, ' ') || ' '"


def preview(x: str) -> str:
    # the longest prefix of at most 100 bytes
    k = f"list_max(list_filter(range(0, 101), lambda k: strlen(substring({x}, 1, k)) <= 100))"
    return rf"trim(regexp_replace(substring({x}, 1, {k}), '\s+', ' ', 'g')) || CASE WHEN strlen({x}) > 100 THEN '...' ELSE '' END"


FILES = f"""files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS content, sha256(text) AS content_hash,
  {NOW} - doc_id * 60 AS mtime, {NOW} - doc_id * 30 AS indexed_at, CAST(strlen(text) // 4 AS INTEGER) AS token_count, doc_id FROM documents)"""
NODES = FILES + f""",
nodes AS (SELECT 'h' || substring(sha256(file_path || ':7:0-' || strlen(content)), 1, 24) AS id, file_path, CAST(0 AS BIGINT) AS node_ord, 7 AS node_type,
  CAST(0 AS BIGINT) AS start_byte, CAST(strlen(content) AS BIGINT) AS end_byte, 1 AS line_start,
  CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS line_end, token_count, {preview('content')} AS preview, content
  FROM files WHERE content <> '')"""
SOURCES = f"""snodes AS (SELECT 'h' || substring(sha256(source || '.txt:7:' || doc_id || '-' || (doc_id + strlen(text))), 1, 24) AS id, source || '.txt' AS file_path,
  doc_id AS node_ord, CAST(doc_id % 8 AS INTEGER) AS node_type, CAST(doc_id * 10 + 1 AS INTEGER) AS line_start, CAST(doc_id * 10 + 4 AS INTEGER) AS line_end,
  CAST(strlen(text) // 4 AS INTEGER) AS token_count, {preview('text')} AS preview, text AS content FROM documents)"""
PARTS = """parts AS (SELECT 'h' || substring(sha256('part/' || p_type || ':' || (p_size % 8) || ':' || (p_partkey * 100) || '-' || (p_partkey * 100 + p_size)), 1, 24) AS id,
  'part/' || p_type AS file_path, p_partkey AS node_ord, CAST(p_size % 8 AS INTEGER) AS node_type, CAST(p_size AS INTEGER) AS token_count, p_name AS preview,
  p_name AS name, lower(p_name) AS name_lower, lower(p_brand) AS parent_name_lower FROM part)"""
REFS = """refs AS (SELECT 'part/' || p_type AS file_path, p_name AS name, lower(p_name) AS name_lower, p_brand AS qualifier,
  CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'type_ref' END AS ref_type,
  'h' || substring(sha256('part/' || p_type || ':' || (p_size % 8) || ':' || (p_partkey * 100) || '-' || (p_partkey * 100 + p_size)), 1, 24) AS source_id,
  l_orderkey * 10 + l_linenumber AS start_byte, l_orderkey * 10 + l_linenumber + length(p_name) AS end_byte, CAST(l_orderkey AS INTEGER) AS line_start,
  CAST(l_orderkey AS INTEGER) AS line_end, p_name || ' ' || l_suppkey AS preview FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EVENTS = """e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
queries AS (SELECT event_id AS id, ts, 'k' || k AS query_text, list_transform(range(0, 6), lambda i: '**/g' || ((k + i) % 10) || '/**') AS predicted_globs, user_id, k FROM e WHERE event_type = 'view'),
handles AS (SELECT event_id AS query_event_id, 'h' || k AS handle_id, CAST(k % 8 AS INTEGER) AS node_type, CAST(round(value) AS INTEGER) AS token_count, '**/g' || (k % 10) || '/**' AS first_match_glob FROM e WHERE event_type = 'view'),
expands AS (SELECT a.event_id AS id, q.id AS query_event_id, 'h' || a.k AS handle_id, CAST(round(a.value) AS INTEGER) AS token_count, a.ts AS expanded_at FROM e a JOIN queries q ON a.user_id = q.user_id AND a.k = q.k WHERE a.event_type IN ('click', 'purchase')),
flagged AS (SELECT h.*, EXISTS (SELECT 1 FROM expands x WHERE x.query_event_id = h.query_event_id AND x.handle_id = h.handle_id) AS expanded FROM handles h)"""
HANDLE = "id, file_path, node_type, token_count, preview, node_ord"


def contains(text: str, column: str = "content") -> str:
    return f"contains({norm(column)}, ' {text} ')"


def found(where: str, table: str = "nodes", limit: int | None = 100, name: str = "f") -> str:
    cut = f" ORDER BY file_path, node_ord LIMIT {limit}" if limit else ""
    return f"{name} AS (SELECT {HANDLE} FROM {table} WHERE {where}{cut})"


TYPE_WEIGHT = "[0.6, 0.5, 0.2, 1.0, 0.8, 0.8, 1.0, 0.3]"


def score(terms: list[str]) -> str:
    hits = " + ".join(f"CAST(contains(hay, '{t}') AS INTEGER)" for t in terms)
    return (
        f"round(0.6::DOUBLE * greatest(({hits})::DOUBLE / {len(terms)}, 0.1::DOUBLE) + 0.25::DOUBLE * (({TYPE_WEIGHT}::DOUBLE[])[node_type + 1])"
        " + 0.15::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + ln(greatest(token_count, 1)::DOUBLE))), 9)"
    )


def pack(source: str, terms: list[str], handles: int = 8, per_file: int = 2) -> str:
    order = "score DESC, token_count, file_path, node_ord"
    return f"""hay AS (SELECT *, lower(file_path) || ' ' || lower(preview) AS hay FROM {source}),
scored AS (SELECT {HANDLE}, {score(terms)} AS score FROM hay),
capped AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {order}) AS in_file FROM scored),
best AS (SELECT * FROM capped WHERE in_file <= {per_file} ORDER BY {order} LIMIT {handles}),
pack AS (SELECT {HANDLE}, score, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM best)"""
