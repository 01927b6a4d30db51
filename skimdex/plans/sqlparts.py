"""DuckDB SQL fragments used by the oracle queries.

They restate each rule independently in plain SQL over the driver tables; the
only pieces shared with the Spark side are the corpus layouts (how a row of
``documents`` / ``part`` / ``orders`` becomes a file or a request), which are
input definitions, not results.
"""

from __future__ import annotations

from skimdex.sources.corpus import (
    COMPARED,
    DECORATED,
    ESCAPED,
    LISTED_CLASS,
    code_content_sql,
    code_path_sql,
    code_target_sql,
    doc_path_sql,
)
from skimdex.sources.requests import payload_sql, requests_sql_select

NL = "chr(10)"


def docs_files_cte() -> str:
    return (
        "files AS (SELECT '/corpus/' || source AS target_dir, "
        f"{doc_path_sql()} AS path, text AS content, CAST(strlen(text) AS BIGINT) AS size_bytes, doc_id "
        "FROM documents)"
    )


def code_files_cte(name: str = "files") -> str:
    return (
        f"{name} AS (SELECT {code_target_sql()} AS target_dir, {code_path_sql()} AS path, "
        f"{code_content_sql()} AS content, p_partkey, p_name, p_brand, p_type, p_size FROM part), "
        f"{name}_sized AS (SELECT *, CAST(strlen(content) AS BIGINT) AS size_bytes FROM {name})"
    )


def requests_cte() -> str:
    return (
        f"req AS (SELECT {requests_sql_select()} "
        "FROM orders o LEFT JOIN documents d ON o.o_custkey = d.doc_id)"
    )


def payloads_cte() -> str:
    return (
        "pay AS (SELECT CAST(o.o_orderkey AS BIGINT) AS request_id, CAST(o.o_custkey AS BIGINT) AS session_id, "
        f"{payload_sql()} AS payload FROM orders o LEFT JOIN documents d ON o.o_custkey = d.doc_id)"
    )


def not_pruned(p: str = "path") -> str:
    return f"NOT list_has_any(string_split({p}, '/'), ['node_modules', 'dist', '.git'])"


def src_ext(p: str = "path") -> str:
    return f"(ends_with({p}, '.ts') OR ends_with({p}, '.tsx'))"


def indexable(p: str = "path") -> str:
    return (
        f"({not_pruned(p)} AND {src_ext(p)} AND NOT (ends_with({p}, '.d.ts') "
        f"OR ends_with({p}, '.test.ts') OR ends_with({p}, '.spec.ts')))"
    )


def naive_scope(p: str = "path") -> str:
    return f"({not_pruned(p)} AND {src_ext(p)} AND NOT ends_with({p}, '.d.ts'))"


def tokens(x: str) -> str:
    return f"CAST(round(length({x}) / 4) AS BIGINT)"


def nlines(x: str) -> str:
    return f"CAST(len(string_split({x}, {NL})) AS INT)"


def size_kb(x: str) -> str:
    return f"(round({x} / 1024 * 10) / 10)"


def normalize(p: str) -> str:
    fold = (
        f"list_reduce(string_split({p}, '/'), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '') "
        "WHEN s IN ('.', '') THEN acc WHEN acc = '' THEN s ELSE acc || '/' || s END, '')"
    )
    return f"(CASE WHEN starts_with({p}, '/') THEN '/' ELSE '' END || {fold})"


def js_slice(lst: str, b: str, e: str) -> str:
    n = f"len({lst})"
    b2 = f"(CASE WHEN ({b}) < 0 THEN greatest({n} + ({b}), 0) ELSE least({b}, {n}) END)"
    e2 = f"(CASE WHEN ({e}) < 0 THEN greatest({n} + ({e}), 0) ELSE least({e}, {n}) END)"
    return f"list_slice({lst}, {b2} + 1, {e2})"


def dirname(p: str = "path") -> str:
    return f"array_to_string(list_slice(string_split({p}, '/'), 1, len(string_split({p}, '/')) - 1), '/')"


# ---------------------------------------------------------------------------
# Expected exports of the generated code corpus, computed from part columns
# (no parsing): the oracle of the extraction queries.
# ---------------------------------------------------------------------------

def _pascal() -> str:
    w1, w2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    return f"(upper(left({w1}, 1)) || substr({w1}, 2) || upper(left({w2}, 1)) || substr({w2}, 2))"


def code_symbols_cte() -> str:
    """``expected(target_dir, path, ord, kind, name, params, return_type, docstring)``."""
    P, k = _pascal(), "CAST(p_partkey AS VARCHAR)"
    base = f"SELECT target_dir, path, p_partkey, p_name, p_brand, p_type, p_size, {P} AS pc FROM files WHERE p_size % 10 <> 0"
    doc = (
        "CASE WHEN p_size % 3 <> 0 THEN left(trim('Loads ' || p_name || ' parts of ' || p_brand || '.' || "
        "CASE WHEN p_size > 40 THEN ' ' || repeat('More detail here. ', 8) ELSE '' END), 120) END"
    )
    fn = (
        f"SELECT target_dir, path, 1 AS ord, 'function' AS kind, 'get' || pc || {k} AS name, "
        "'id: number, label: string, opts: { strict: boolean }' || "
        f"CASE WHEN {COMPARED} THEN ', low: any, high: number' ELSE '' END AS params, "
        f"CASE WHEN p_size % 4 = 1 THEN 'unknown' ELSE 'Promise<' || pc || 'Info' || {k} || '>' END AS return_type, "
        f"{doc} AS docstring FROM g"
    )
    scope = "CASE j % 4 WHEN 1 THEN 'protected' ELSE 'public' END"
    methods = (
        f"list_slice(list_concat(CASE WHEN {DECORATED} THEN ['public onEvent(e: Event): void'] ELSE [] END, "
        f"list_transform(list_filter(range(p_size % 8), lambda j: j % 4 <> 2), "
        f"lambda j: {scope} || ' m' || CAST(j AS VARCHAR) || '(x: number, tag: string): string')), 1, 5)"
    )
    late = f"SELECT target_dir, path, 3, 'class', 'Late' || {k}, '', '', NULL FROM g WHERE {LISTED_CLASS}"
    after = f"CASE WHEN {LISTED_CLASS} THEN 1 ELSE 0 END"
    cls = (
        f"SELECT target_dir, path, 2, 'class', pc || 'Store' || {k}, "
        f"array_to_string(CASE WHEN p_size % 2 = 0 THEN list_prepend('constructor(name: string, size: number)', {methods}) "
        f"ELSE {methods} END, ' | '), '', NULL FROM g"
    )
    prop = (
        "lambda i: 'p' || CAST(i AS VARCHAR) || CASE WHEN i % 2 = 1 THEN '?' ELSE '' END || ': ' || "
        "CASE i % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' ELSE 'Map<string, number>' END"
    )
    iface = (
        f"SELECT target_dir, path, 3 + {after}, 'interface', pc || 'Info' || {k}, "
        f"array_to_string(list_transform(range(least(p_size % 11, 8)), {prop}), '; '), '', NULL FROM g"
    )
    union = " || ".join(f"' | \"alpha-{i}\"'" for i in range(20))
    typ = (
        f"SELECT target_dir, path, 4 + {after}, 'type', pc || 'Key' || {k}, "
        "left('\"' || p_brand || '\" | number | Array<{ id: number; tag: \"' || split_part(p_name, ' ', 1) || '\" }>' || "
        f"CASE WHEN {ESCAPED} THEN ' | \"q' || chr(92) || '\"t\"' ELSE '' END || "
        f"CASE WHEN p_size > 45 THEN {union} ELSE '' END, 200), '', NULL FROM g"
    )
    enum = (
        f"SELECT target_dir, path, 5 + {after}, 'enum', pc || 'Kind' || {k}, "
        "array_to_string(list_transform(range(p_size % 4 + 1), lambda i: upper(p_type) || '_' || CAST(i AS VARCHAR)), ', '), '', NULL FROM g"
    )
    return (
        f"g AS ({base}), expected AS ({fn} UNION ALL {cls} UNION ALL {late} UNION ALL {iface} UNION ALL {typ} UNION ALL {enum})"
    )


def code_manifests_cte() -> str:
    return (
        "ctops AS (SELECT DISTINCT target_dir, split_part(path, '/', 1) AS top FROM files), "
        "manifests AS (SELECT DISTINCT target_dir, '' AS dir, '{\"name\": \"@parts/' || substr(target_dir, 7) || '\"}' AS content "
        "FROM ctops WHERE target_dir <> '/repo/promo' "
        "UNION ALL SELECT target_dir, top, '{\"version\": \"1.0.0\"}' FROM ctops WHERE CAST(substr(top, 6) AS INT) % 5 = 0), "
        "names AS (SELECT target_dir, dir, CASE WHEN json_valid(content) THEN json_extract_string(content, '$.name') END AS name FROM manifests), "
        "cpkg AS (SELECT f.target_dir, f.path, CASE WHEN CAST(substr(split_part(f.path, '/', 1), 6) AS INT) % 5 = 0 THEN NULL "
        "ELSE (SELECT n.name FROM names n WHERE n.target_dir = f.target_dir AND n.dir = '') END AS package_name FROM files f)"
    )


def js_number(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def code_skeleton_ctes() -> str:
    """Per-file skeleton text blocks of the code corpus, from ``expected``."""
    line = (
        "CASE kind WHEN 'function' THEN '  ' || name || '(' || params || '): ' || return_type "
        "WHEN 'interface' THEN '  interface ' || name || ' { ' || params || ' }' "
        "WHEN 'class' THEN '  class ' || name || ' — methods: ' || params "
        "WHEN 'type' THEN '  type ' || name || ' = ' || params "
        "ELSE '  enum ' || name || ' { ' || params || ' }' END || coalesce('  // ' || docstring, '')"
    )
    return (
        f"sig AS (SELECT target_dir, path, ord, {line} AS line FROM expected), "
        "blk AS (SELECT s.target_dir, s.path, chr(10) || '\"' || s.path || '\"' || coalesce(' [' || p.package_name || ']', '') || "
        f"' (' || {js_number('f.kb')} || 'kb)' || chr(10) || string_agg(s.line, chr(10) ORDER BY s.ord) AS text "
        "FROM sig s JOIN (SELECT target_dir, path, round(size_bytes / 1024 * 10) / 10 AS kb FROM files_sized) f "
        "ON s.target_dir = f.target_dir AND s.path = f.path "
        "JOIN cpkg p ON s.target_dir = p.target_dir AND s.path = p.path "
        "GROUP BY s.target_dir, s.path, p.package_name, f.kb), "
        "totals AS (SELECT target_dir, count(*) AS files_indexed, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS skeleton_chars, "
        "CAST(round((sum(length(text)) + count(*) - 1) / 4) AS BIGINT) AS skeleton_tokens FROM blk GROUP BY target_dir)"
    )


# ---------------------------------------------------------------------------
# Snapshot oracles
# ---------------------------------------------------------------------------

BASE_EPOCH = 1704067200
EDIT_SECONDS = 86400


def docs_manifest_v1_cte(name: str = "man1") -> str:
    return (
        f"{name} AS (SELECT '/corpus/' || source AS target_dir, {doc_path_sql()} AS path, "
        f"CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(({BASE_EPOCH} + doc_id * 60) * 1000 AS BIGINT) AS mtime_ms "
        f"FROM documents WHERE {indexable(doc_path_sql())})"
    )


def docs_manifest_v2_cte(name: str = "man2") -> str:
    content = f"CASE WHEN quality = 0 THEN text || chr(10) || '// revised' ELSE text END"
    return (
        f"d2 AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), "
        f"{name}_all AS (SELECT '/corpus/' || source AS target_dir, {doc_path_sql()} AS path, "
        f"CAST(strlen({content}) AS BIGINT) AS size_bytes, "
        f"CAST(({BASE_EPOCH} + doc_id * 60 + CASE WHEN quality = 0 THEN {EDIT_SECONDS} ELSE 0 END) * 1000 AS BIGINT) AS mtime_ms "
        f"FROM d2 WHERE coalesce(toxic, 0) = 0 "
        f"UNION ALL SELECT '/corpus/bench', 'items/item_' || CAST(item_id AS VARCHAR) || '.ts', CAST(strlen(text) AS BIGINT), "
        f"CAST(({BASE_EPOCH} + {EDIT_SECONDS} + item_id) * 1000 AS BIGINT) FROM benchmark), "
        f"{name} AS (SELECT * FROM {name}_all WHERE {indexable()})"
    )


def code_v2_files_cte(name: str = "files") -> str:
    extra = "(chr(10) || 'export function extra' || CAST(p_partkey AS VARCHAR) || '(): void {}' || chr(10))"
    content = f"CASE WHEN p_size % 10 = 1 THEN {code_content_sql()} || {extra} ELSE {code_content_sql()} END"
    return (
        f"{name} AS (SELECT {code_target_sql()} AS target_dir, {code_path_sql()} AS path, {content} AS content, "
        f"CAST(({BASE_EPOCH} + p_partkey * 60 + CASE WHEN p_size % 10 = 1 THEN {EDIT_SECONDS} ELSE 0 END) * 1000 AS BIGINT) AS mtime_ms, "
        f"p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size % 10 <> 9), "
        f"{name}_sized AS (SELECT *, CAST(strlen(content) AS BIGINT) AS size_bytes FROM {name})"
    )


def code_manifest_cte(src: str, name: str, v2: bool = False) -> str:
    mt = "mtime_ms" if v2 else f"CAST(({BASE_EPOCH} + p_partkey * 60) * 1000 AS BIGINT)"
    return f"{name} AS (SELECT target_dir, path, size_bytes, {mt} AS mtime_ms FROM {src} WHERE {indexable()})"


def fingerprint_cte(man: str, name: str) -> str:
    lanes = " || '|' || ".join(
        f"CAST(sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT) AS VARCHAR)" for i in range(4)
    )
    return (
        f"{name}_h AS (SELECT target_dir, sha256(path || '|' || CAST(size_bytes AS VARCHAR) || '|' || CAST(mtime_ms AS VARCHAR)) AS h FROM {man}), "
        f"{name} AS (SELECT target_dir, count(*) AS n_files, sha256('v1|' || target_dir || '|' || CAST(count(*) AS VARCHAR) || '|' || {lanes}) AS fingerprint "
        f"FROM {name}_h GROUP BY target_dir)"
    )
