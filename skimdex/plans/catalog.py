"""Registered queries: one Spark job per operator, each with its oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``
(DuckDB SQL over the driver tables; absent for operators that are only checked
row-wise). Column names of both sides are identical.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.functions import text as T
from skimdex.operators import budget, packages, reads, requests, scope
from skimdex.plans import sqlparts as S
from skimdex.sources import corpus as C
from skimdex.sources import requests as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _docs(spark, sf):
    return C.documents_corpus(spark, sf)


# --------------------------------------------------------------------------
# scans and scalar projections over the documents corpus
# --------------------------------------------------------------------------

@query(
    "domain_scope",
    f"WITH {S.docs_files_cte()}, langs AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), "
    "scopes AS (SELECT 'text-' || lang AS domain, lang AS prefix FROM langs UNION ALL SELECT 'vendor-' || lang, 'node_modules/' || lang FROM langs "
    "UNION ALL VALUES ('vendor', 'node_modules'), ('built', 'dist'), ('built', '.storybook'), ('stories', '.storybook')) "
    "SELECT target_dir, path, size_bytes, domain FROM (SELECT f.target_dir, f.path, f.size_bytes, s.domain, row_number() OVER "
    "(PARTITION BY f.target_dir, f.path ORDER BY length(s.prefix) DESC, s.domain) AS n FROM files f JOIN scopes s "
    "ON starts_with(f.path, s.prefix || '/')) WHERE n = 1",
)
def q_domain_scope(spark, sf):
    """Each file's domain: of overlapping scopes the one with the longest prefix."""
    return scope.domain_scope(_docs(spark, sf), C.documents_scopes(spark, sf), ["size_bytes"])


@query(
    "scan_indexable",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, size_bytes FROM files WHERE {S.indexable()}",
)
def q_scan_indexable(spark, sf):
    return scope.scan_indexable(_docs(spark, sf)).select("target_dir", "path", "size_bytes")


@query(
    "scan_naive_scope",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, size_bytes FROM files WHERE {S.naive_scope()}",
)
def q_scan_naive_scope(spark, sf):
    return scope.scan_naive_scope(_docs(spark, sf)).select("target_dir", "path", "size_bytes")


@query(
    "text_snapshot",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, "
    f"CASE WHEN NOT contains(content, chr(0)) THEN {S.nlines('content')} END AS total_lines, "
    "contains(content, chr(0)) AS is_binary, "
    "CASE WHEN contains(content, chr(0)) THEN 'Binary file, cannot read: ' || target_dir || '/' || path END AS error, "
    "size_bytes FROM files",
)
def q_text_snapshot(spark, sf):
    return scope.text_snapshot(_docs(spark, sf))


def _windows_style(path_col):
    return F.contains(path_col, F.lit("de/"))


@query(
    "relative_path",
    f"WITH {S.docs_files_cte()}, a AS (SELECT target_dir, path, "
    "CASE WHEN contains(path, 'de/') THEN replace(target_dir || '/' || path, '/', chr(92)) ELSE target_dir || '/' || path END AS abs_path, "
    "CASE WHEN contains(path, 'de/') THEN replace(target_dir, '/', chr(92)) ELSE target_dir END AS base FROM files) "
    "SELECT abs_path, base, substr(replace(abs_path, chr(92), '/'), length(base) + 2) AS rel_path FROM a",
)
def q_relative_path(spark, sf):
    f = _docs(spark, sf)
    abs_p = F.concat("target_dir", F.lit("/"), "path")
    win = _windows_style(F.col("path"))
    f = f.select(
        F.when(win, F.replace(abs_p, F.lit("/"), F.lit("\\"))).otherwise(abs_p).alias("abs_path"),
        F.when(win, F.replace("target_dir", F.lit("/"), F.lit("\\"))).otherwise(F.col("target_dir")).alias("base"),
    )
    return f.select("abs_path", "base", P.relative_path("abs_path", "base").alias("rel_path"))


@query(
    "file_size_kb",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, size_bytes, {S.size_kb('size_bytes')} AS size_kb FROM files",
)
def q_file_size_kb(spark, sf):
    return _docs(spark, sf).select("target_dir", "path", "size_bytes", T.size_kb("size_bytes").alias("size_kb"))


@query(
    "token_estimate",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, CAST(length(content) AS INT) AS utf16_length, "
    f"{S.tokens('content')} AS token_estimate FROM files",
)
def q_token_estimate(spark, sf):
    return _docs(spark, sf).select(
        "target_dir", "path", T.utf16_length("content").alias("utf16_length"),
        T.token_estimate("content").alias("token_estimate"),
    )


@query(
    "line_counts",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, {S.nlines('content')} AS total_lines, "
    "ends_with(content, chr(10)) AS trailing_newline, "
    "CAST(len(list_filter(string_split(content, chr(10)), lambda l: trim(l) = '')) AS INT) AS blank_lines FROM files",
)
def q_line_counts(spark, sf):
    lines = T.lines("content")
    return _docs(spark, sf).select(
        "target_dir", "path", F.size(lines).alias("total_lines"),
        F.endswith("content", F.lit("\n")).alias("trailing_newline"),
        F.size(F.filter(lines, lambda l: F.trim(l) == "")).alias("blank_lines"),
    )


@query(
    "truncate_text",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, nullif(left(content, 120), '') AS docstring, "
    "left(content, 200) AS type_text FROM files",
)
def q_truncate_text(spark, sf):
    return _docs(spark, sf).select(
        "target_dir", "path",
        T.blank_to_null(T.cut("content", T.DOCSTRING_CHARS)).alias("docstring"),
        T.cut("content", T.TYPE_TEXT_CHARS).alias("type_text"),
    )


@query(
    "naive_tokens",
    f"WITH {S.docs_files_cte()} SELECT target_dir, count(*) AS naive_files, "
    f"CAST(sum({S.tokens('content')}) AS BIGINT) AS naive_tokens FROM files WHERE {S.naive_scope()} GROUP BY target_dir",
)
def q_naive_tokens(spark, sf):
    return budget.naive_tokens(_docs(spark, sf))


# --------------------------------------------------------------------------
# manifests and package names
# --------------------------------------------------------------------------

_DOC_MANIFESTS_SQL = (
    "tops AS (SELECT DISTINCT target_dir, split_part(path, '/', 1) AS top FROM files), "
    "manifests AS (SELECT DISTINCT target_dir, '' AS dir, '{\"name\": \"@docs/' || substr(target_dir, 9) || '\"}' AS content FROM tops "
    "UNION ALL SELECT target_dir, top AS dir, CASE WHEN top = 'de' THEN '{\"private\": true}' ELSE '{\"name\": \"broken' END FROM tops "
    "WHERE top IN ('de', 'es')), "
    "names AS (SELECT target_dir, dir, CASE WHEN json_valid(content) THEN json_extract_string(content, '$.name') END AS name FROM manifests)"
)


@query(
    "manifest_names",
    f"WITH {S.docs_files_cte()}, {_DOC_MANIFESTS_SQL} SELECT target_dir, dir, name FROM names",
)
def q_manifest_names(spark, sf):
    return C.manifest_names(C.documents_manifests(_docs(spark, sf)))


_NEAREST_SQL = (
    "fd AS (SELECT target_dir, path, " + S.dirname() + " AS dir FROM files), "
    "segs AS (SELECT DISTINCT target_dir, dir, CASE WHEN dir = '' THEN []::VARCHAR[] ELSE string_split(dir, '/') END AS s FROM fd), "
    "anc AS (SELECT target_dir, dir, i AS lvl, array_to_string(list_slice(s, 1, len(s) - i), '/') AS mdir "
    "FROM segs, LATERAL generate_series(0, least(5, len(s))) g(i)), "
    "hit AS (SELECT a.target_dir, a.dir, a.lvl, n.name FROM anc a JOIN names n ON a.target_dir = n.target_dir AND a.mdir = n.dir), "
    "best AS (SELECT target_dir, dir, name AS package_name FROM (SELECT *, row_number() OVER (PARTITION BY target_dir, dir ORDER BY lvl) AS rn FROM hit) WHERE rn = 1)"
)


@query(
    "nearest_package",
    f"WITH {S.docs_files_cte()}, {_DOC_MANIFESTS_SQL}, {_NEAREST_SQL} "
    "SELECT fd.target_dir, fd.path, b.package_name FROM fd LEFT JOIN best b ON fd.target_dir = b.target_dir AND fd.dir = b.dir",
)
def q_nearest_package(spark, sf):
    files = _docs(spark, sf).select("target_dir", "path")
    return packages.nearest_package(files, C.documents_manifests(_docs(spark, sf)))


# --------------------------------------------------------------------------
# read requests
# --------------------------------------------------------------------------

_READS_SQL = (
    "r2 AS (SELECT *, " + S.normalize("base_dir || '/' || path") + " AS file_path, " + S.normalize("base_dir") + " AS base_norm FROM req), "
    "r3 AS (SELECT *, (file_path = base_norm OR starts_with(file_path, rtrim(base_norm, '/') || '/')) AS in_base FROM r2), "
    "fa AS (SELECT target_dir || '/' || path AS abs_path, content FROM files), "
    "j AS (SELECT r3.*, fa.abs_path, fa.content, string_split(fa.content, chr(10)) AS lines, "
    "coalesce(r3.max_lines, 300) AS ml FROM r3 LEFT JOIN fa ON r3.file_path = fa.abs_path AND r3.in_base), "
    "k AS (SELECT *, len(lines) AS total, "
    "CASE WHEN coalesce(symbols_only, false) THEN 'symbols-only' WHEN line_start IS NOT NULL AND line_end IS NOT NULL THEN 'line-range' "
    "WHEN len(lines) <= ml THEN 'full' ELSE 'capped' END AS m, "
    "CASE WHEN NOT in_base THEN 'Path escapes baseDir: ' || file_path WHEN abs_path IS NULL THEN 'File not found: ' || file_path "
    "WHEN contains(content, chr(0)) THEN 'Binary file, cannot read: ' || file_path END AS err FROM j), "
    "b AS (SELECT *, CASE m WHEN 'symbols-only' THEN '// symbols-only mode: ' || split_part(file_path, '/', -1) "
    "WHEN 'line-range' THEN array_to_string(" + S.js_slice("lines", "line_start - 1", "line_end") + ", chr(10)) "
    "WHEN 'full' THEN content ELSE array_to_string(" + S.js_slice("lines", "0", "ml") + ", chr(10)) END AS body, "
    "CASE m WHEN 'symbols-only' THEN 1 WHEN 'line-range' THEN len(" + S.js_slice("lines", "line_start - 1", "line_end") + ") "
    "WHEN 'full' THEN len(lines) ELSE ml END AS returned FROM k), "
    "reads AS (SELECT request_id, session_id, file_path AS path, "
    "CASE WHEN err IS NULL THEN CASE WHEN m = 'capped' THEN body || chr(10) || chr(10) || '// ... [' || CAST(total - ml AS VARCHAR) "
    "|| ' more lines, use lineRange to read further]' ELSE body END END AS content, "
    "CASE WHEN err IS NULL THEN CAST(returned AS INT) END AS lines_returned, "
    "CASE WHEN err IS NULL THEN CAST(total AS INT) END AS total_lines, "
    "CASE WHEN err IS NULL THEN " + S.tokens("body") + " END AS token_estimate, "
    "CASE WHEN err IS NULL THEN m END AS mode, CASE WHEN err IS NOT NULL THEN -32603 END AS error_code, err AS error FROM b)"
)

_READ_COLS = ", ".join(reads.READ_COLUMNS)


def _reads(spark, sf):
    return reads.read_requests(R.read_requests_table(spark, sf), _docs(spark, sf))


@query("read_requests", f"WITH {S.docs_files_cte()}, {S.requests_cte()}, {_READS_SQL} SELECT {_READ_COLS} FROM reads")
def q_read_requests(spark, sf):
    return _reads(spark, sf).select(*reads.READ_COLUMNS)


for _mode, _key in (("full", "read_full"), ("capped", "read_capped"), ("line-range", "read_line_range")):
    def _mk(mode):
        def fn(spark, sf):
            return _reads(spark, sf).where(F.col("mode") == mode).select(*reads.READ_COLUMNS)
        return fn

    query(_key, f"WITH {S.docs_files_cte()}, {S.requests_cte()}, {_READS_SQL} SELECT {_READ_COLS} FROM reads WHERE mode = '{_mode}'")(_mk(_mode))


@query(
    "path_boundary",
    f"WITH {S.requests_cte()}, {_READS_SQL.split(', fa AS')[0]} SELECT request_id, base_dir, path, file_path, in_base FROM r3",
)
def q_path_boundary(spark, sf):
    return reads.resolve(R.read_requests_table(spark, sf)).select("request_id", "base_dir", "path", "file_path", "in_base")


@query(
    "read_accounting",
    f"WITH {S.docs_files_cte()}, {S.requests_cte()}, {_READS_SQL} SELECT session_id, count(*) AS calls, "
    "count(*) FILTER (WHERE error IS NULL) AS files_read, CAST(coalesce(sum(token_estimate), 0) AS BIGINT) AS file_tokens, "
    "count(*) FILTER (WHERE error IS NOT NULL) AS errors FROM reads GROUP BY session_id",
)
def q_read_accounting(spark, sf):
    return budget.read_accounting(_reads(spark, sf))


_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE', 'INTEGER', 'HUGEINT')"
_COERCE_SQL = (
    "c0 AS (SELECT request_id, session_id, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS payload, json_valid(payload) AS ok FROM pay), "
    "coerced AS (SELECT request_id, session_id, ok AS valid_json, "
    "CASE WHEN ok AND json_type(payload, '$.name') = 'VARCHAR' THEN json_extract_string(payload, '$.name') END AS tool, "
    "CASE WHEN ok AND json_type(payload, '$.arguments.path') = 'VARCHAR' THEN json_extract_string(payload, '$.arguments.path') END AS path, "
    "CASE WHEN ok AND json_type(payload, '$.arguments.baseDir') = 'VARCHAR' THEN json_extract_string(payload, '$.arguments.baseDir') END AS base_dir, "
    f"CASE WHEN ok AND json_type(payload, '$.arguments.maxLines') IN {_NUM} THEN CAST(trunc(least(greatest(CAST(json_extract(payload, '$.arguments.maxLines') AS DOUBLE), -2147483648), 2147483647)) AS INT) END AS max_lines, "
    "CASE WHEN ok AND json_type(payload, '$.arguments.symbolsOnly') = 'BOOLEAN' THEN CAST(json_extract(payload, '$.arguments.symbolsOnly') AS BOOLEAN) END AS symbols_only, "
    "CASE WHEN ok AND json_type(payload, '$.arguments.targetDir') = 'VARCHAR' THEN json_extract_string(payload, '$.arguments.targetDir') END AS target_dir, "
    "CASE WHEN ok AND json_type(payload, '$.arguments.forceRefresh') = 'BOOLEAN' THEN CAST(json_extract(payload, '$.arguments.forceRefresh') AS BOOLEAN) END AS force_refresh, "
    "CASE WHEN ok AND json_type(payload, '$.arguments.clearReadFileCache') = 'BOOLEAN' THEN CAST(json_extract(payload, '$.arguments.clearReadFileCache') AS BOOLEAN) END AS clear_read_file_cache, "
    f"CASE WHEN ok AND json_type(payload, '$.arguments.lineRange') = 'ARRAY' AND json_array_length(payload, '$.arguments.lineRange') = 2 "
    f"AND json_type(payload, '$.arguments.lineRange[0]') IN {_NUM} AND json_type(payload, '$.arguments.lineRange[1]') IN {_NUM} "
    "THEN CAST(trunc(least(greatest(CAST(json_extract(payload, '$.arguments.lineRange[0]') AS DOUBLE), -2147483648), 2147483647)) AS INT) END AS line_start, "
    f"CASE WHEN ok AND json_type(payload, '$.arguments.lineRange') = 'ARRAY' AND json_array_length(payload, '$.arguments.lineRange') = 2 "
    f"AND json_type(payload, '$.arguments.lineRange[0]') IN {_NUM} AND json_type(payload, '$.arguments.lineRange[1]') IN {_NUM} "
    "THEN CAST(trunc(least(greatest(CAST(json_extract(payload, '$.arguments.lineRange[1]') AS DOUBLE), -2147483648), 2147483647)) AS INT) END AS line_end FROM c0)"
)
_COERCE_COLS = "request_id, session_id, valid_json, tool, path, base_dir, max_lines, symbols_only, line_start, line_end, target_dir, force_refresh, clear_read_file_cache"


@query("coerce_requests", f"WITH {S.payloads_cte()}, {_COERCE_SQL} SELECT {_COERCE_COLS} FROM coerced")
def q_coerce_requests(spark, sf):
    return requests.coerce_requests(R.request_payloads(spark, sf))


_VALIDATE_SQL = (
    "validated AS (SELECT *, "
    "CASE WHEN NOT valid_json THEN -32700 WHEN coalesce(tool, '') = '' THEN -32602 "
    "WHEN tool NOT IN ('read_file', 'repo_index', 'index_cache_invalidate', 'index_cache_stats') THEN -32601 "
    "WHEN tool = 'read_file' AND (coalesce(path, '') = '' OR coalesce(base_dir, '') = '') THEN -32602 "
    "WHEN tool <> 'read_file' AND coalesce(target_dir, '') = '' THEN -32602 END AS error_code, "
    "CASE WHEN NOT valid_json THEN 'Parse error' WHEN coalesce(tool, '') = '' THEN 'Missing tool name' "
    "WHEN tool NOT IN ('read_file', 'repo_index', 'index_cache_invalidate', 'index_cache_stats') THEN 'Unknown tool: ' || tool "
    "WHEN tool = 'read_file' AND (coalesce(path, '') = '' OR coalesce(base_dir, '') = '') THEN 'read_file requires path and baseDir' "
    "WHEN tool <> 'read_file' AND coalesce(target_dir, '') = '' THEN tool || ' requires targetDir' END AS error FROM coerced)"
)


@query(
    "validate_requests",
    f"WITH {S.payloads_cte()}, {_COERCE_SQL}, {_VALIDATE_SQL} SELECT request_id, tool, CAST(error_code AS INT) AS error_code, error FROM validated",
)
def q_validate_requests(spark, sf):
    return requests.validate_requests(requests.coerce_requests(R.request_payloads(spark, sf))).select(
        "request_id", "tool", "error_code", "error"
    )


# --------------------------------------------------------------------------
# signature extraction over the generated code corpus (oracle: expected
# signatures computed from the part columns)
# --------------------------------------------------------------------------

from skimdex.operators import skeleton as K  # noqa: E402
from skimdex.operators import symbols as Y  # noqa: E402
from skimdex.operators import tokens as TK  # noqa: E402


def _code(spark, sf):
    return C.code_corpus(spark, sf)


def _extraction(spark, sf, kinds=None):
    files = _code(spark, sf)
    return files, Y.extract(Y.source_candidates(files), kinds)


def _declared(files):
    return Y.exported_declarations(Y.source_candidates(files))


_G = f"WITH {S.code_files_cte()}, {S.code_symbols_cte()}"
_SYM_COLS = "target_dir, path, name, params, return_type, docstring"


def _tok_sql() -> str:
    # A flat pattern of its own: every comment, run of blanks, string, word and
    # sign is a piece; what isn't blank or comment is a token.
    pat = (r"//[^\n]*|/\*[\s\S]*?\*/|\s+|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|=>|\.\.\.|[A-Za-z_$][A-Za-z0-9_$]*"
           r"|[0-9][0-9A-Za-z_.]*|[^\sA-Za-z0-9_$]").replace("'", "''")
    mask = '\\\\["\'`\\\\/]'.replace("'", "''")
    # The generator's literals that need modes, as the one token that each is.
    plain = "content"
    for shape, token in ((C.TEMPLATE, "`t`"), (C.REGEX, "re"), (C.JSX, "jsx")):
        plain = f"replace({plain}, {C.quoted(shape)}, '{token}')"
    return (
        f"m AS (SELECT target_dir, path, p_size, list_filter(regexp_extract_all(regexp_replace({plain}, '{mask}', '__', 'g'), '{pat}'), "
        r"lambda x: NOT regexp_matches(x, '^(\s|//|/\*)')) AS toks FROM files), "
        "u AS (SELECT target_dir, path, p_size, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM m), "
        "d AS (SELECT *, CASE WHEN tok IN ('{', '(', '[') THEN 1 WHEN tok IN ('}', ')', ']') THEN -1 ELSE 0 END AS delta FROM u), "
        "l AS (SELECT *, sum(delta) OVER (PARTITION BY target_dir, path ORDER BY pos) - CASE WHEN delta = 1 THEN 1 ELSE 0 END AS lvl FROM d)"
    )


@query(
    "code_tokens",
    f"WITH {S.code_files_cte()}, {_tok_sql()} SELECT target_dir, path, count(*) AS n_tokens, "
    "count(*) FILTER (WHERE regexp_matches(tok, '^[A-Za-z_$]')) AS n_words, CAST(max(lvl) AS INT) AS max_depth, "
    f"CAST(sum(delta) AS INT) AS final_depth, sum(delta) = 0 AS balanced, {C.SUSPECT} AS suspect FROM l GROUP BY target_dir, path, p_size",
)
def q_code_tokens(spark, sf):
    return TK.token_stats(_code(spark, sf))


for _kind in Y.KIND_RANK:
    def _mk_kind(kind):
        def run(spark, sf):
            _, x = _extraction(spark, sf, [kind])
            return Y.export_kind(x, kind).select("target_dir", "path", "name", "params", "return_type", "docstring")
        return run

    _key = {"class": "export_classes", "type": "export_types"}.get(_kind, f"export_{_kind}s")
    query(_key, f"{_G} SELECT {_SYM_COLS} FROM expected WHERE kind = '{_kind}'")(_mk_kind(_kind))


@query(
    "symbols",
    f"{_G} SELECT e.target_dir, e.path, CAST(ord AS INT) AS ord, kind, name, params, return_type, docstring, "
    f"{C.SUSPECT} AS suspect FROM expected e JOIN files f ON e.target_dir = f.target_dir AND e.path = f.path",
)
def q_symbols(spark, sf):
    x = Y.declarations(Y.statements(Y.source_candidates(_code(spark, sf))))
    return Y.symbols_from(x).select(*Y.SYMBOL_COLUMNS, "suspect")


@query("capped_exports", f"{_G} SELECT target_dir, path, CAST(ord AS INT) AS ord, kind, name FROM expected WHERE ord <= 3")
def q_capped_exports(spark, sf):
    """The first three symbols of each file."""
    x = Y.symbols_from(Y.declarations(Y.statements(Y.source_candidates(_code(spark, sf)))))
    return Y.capped_exports(x, 3).select("target_dir", "path", "ord", "kind", "name")


@query(
    "export_constants",
    f"WITH {S.code_files_cte()} SELECT target_dir, path, 'const' AS kind, 'LIMIT_' || CAST(p_partkey AS VARCHAR) AS name, 'number' AS params FROM files",
)
def q_export_constants(spark, sf):
    return Y.export_constants(Y.source_candidates(_code(spark, sf))).select("target_dir", "path", "kind", "name", "params")


@query("minimal_index", f"{_G} SELECT target_dir, path, kind, name FROM expected")
def q_minimal_index(spark, sf):
    return Y.minimal_index(_code(spark, sf))


@query("export_filter", f"{_G} SELECT target_dir, path, kind, name FROM expected")
def q_export_filter(spark, sf):
    """Exported declarations only (non-exported helpers, commented-out and
    string-embedded exports, and ``export const`` are left out)."""
    return _declared(_code(spark, sf))


def _skeleton(spark, sf):
    files, x = _extraction(spark, sf)
    syms = Y.symbols_from(x)
    return files, x, syms, K.skeleton_entries(syms, manifests=C.code_manifests(files))


_GK = f"{_G}, {S.code_manifests_cte()}, {S.code_skeleton_ctes()}"


@query(
    "skeleton_entries",
    f"{_GK} SELECT e.target_dir, e.path, round(f.size_bytes / 1024 * 10) / 10 AS size_kb, p.package_name, "
    f"CAST(count(*) AS INT) AS n_exports, string_agg(e.name, ',' ORDER BY e.ord) AS export_names, bool_or({C.SUSPECT}) AS suspect "
    "FROM expected e JOIN files_sized f ON e.target_dir = f.target_dir AND e.path = f.path "
    "JOIN cpkg p ON e.target_dir = p.target_dir AND e.path = p.path GROUP BY e.target_dir, e.path, f.size_bytes, p.package_name",
)
def q_skeleton_entries(spark, sf):
    _, _, _, entries = _skeleton(spark, sf)
    return entries.select(
        "target_dir", "path", "size_kb", "package_name", F.size("exports").alias("n_exports"),
        F.array_join(F.transform("exports", lambda e: e["name"]), ",").alias("export_names"), "suspect",
    )


@query("skeleton_text", f"{_GK} SELECT target_dir, path, text FROM blk")
def q_skeleton_text(spark, sf):
    _, _, _, entries = _skeleton(spark, sf)
    return K.skeleton_text(entries)


@query("skeleton_corpus_text", f"{_GK} SELECT target_dir, files_indexed, skeleton_chars, skeleton_tokens FROM totals")
def q_skeleton_corpus_text(spark, sf):
    _, _, _, entries = _skeleton(spark, sf)
    return K.corpus_totals(K.skeleton_text(entries))


@query(
    "skeleton_corpus_rows",
    f"{_GK} SELECT target_dir, row_number() OVER w AS block_no, CAST(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
    "AS char_offset, path, text FROM blk WINDOW w AS (PARTITION BY target_dir ORDER BY path)",
)
def q_skeleton_corpus_rows(spark, sf):
    """Blocks of each target's prompt text, numbered and placed in the whole string."""
    _, _, _, entries = _skeleton(spark, sf)
    return K.corpus_rows(K.skeleton_text(entries))


@query(
    "token_rollup",
    f"{_GK}, costs AS (SELECT f.target_dir, f.path, p.package_name, {S.tokens('f.content')} AS naive, coalesce({S.tokens('b.text')}, 0) AS brief "
    "FROM files f JOIN cpkg p ON f.target_dir = p.target_dir AND f.path = p.path LEFT JOIN blk b ON f.target_dir = b.target_dir AND f.path = b.path "
    f"WHERE {S.naive_scope('f.path')}), "
    "dirs AS (SELECT target_dir, package_name, naive, brief, unnest(list_transform(range(len(string_split(path, '/'))), "
    "lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir FROM costs) "
    "SELECT target_dir, package_name, CAST(NULL AS VARCHAR) AS dir, grouping(target_dir, package_name) * 2 + 1 AS level, count(*) AS files, "
    "CAST(sum(naive) AS BIGINT) AS naive_tokens, CAST(sum(brief) AS BIGINT) AS skeleton_tokens FROM costs "
    "GROUP BY GROUPING SETS ((target_dir), (target_dir, package_name)) "
    "UNION ALL SELECT target_dir, NULL, dir, 2, count(*), CAST(sum(naive) AS BIGINT), CAST(sum(brief) AS BIGINT) FROM dirs GROUP BY target_dir, dir",
)
def q_token_rollup(spark, sf):
    files, _, _, entries = _skeleton(spark, sf)
    return budget.token_rollup(budget.file_costs(files, K.skeleton_text(entries), C.code_manifests(files)))


@query(
    "index_summary",
    f"{_GK}, scanned AS (SELECT target_dir, count(*) AS files_scanned, count(*) FILTER (WHERE {C.SUSPECT} AND contains(content, 'export')) AS suspect_files "
    f"FROM files WHERE {S.indexable()} GROUP BY target_dir) "
    "SELECT s.target_dir, s.files_scanned, coalesce(t.files_indexed, 0) AS files_indexed, "
    "CAST(coalesce(t.skeleton_tokens, 0) AS BIGINT) AS skeleton_tokens, s.suspect_files FROM scanned s LEFT JOIN totals t ON s.target_dir = t.target_dir",
)
def q_index_summary(spark, sf):
    """Counts of the index, and of the files whose brackets don't match: their exports
    may be missing, so a summary that has some is not whole."""
    files = _code(spark, sf)
    x = Y.extract(Y.source_candidates(files), marks=True)
    entries = K.skeleton_entries(Y.symbols_from(x.where("pos is not null")), manifests=C.code_manifests(files))
    scanned = scope.scan_indexable(files).groupBy("target_dir").agg(F.count("*").alias("files_scanned"))
    totals = K.corpus_totals(K.skeleton_text(entries))
    # Each file's mark comes with its declarations: the texts are lexed once.
    marked = x.where("pos is null and suspect").groupBy("target_dir").agg(F.count("*").alias("suspect_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return scanned.join(totals, "target_dir", "left").join(marked, "target_dir", "left").select(
        "target_dir", "files_scanned", zero("files_indexed"), zero("skeleton_tokens"), zero("suspect_files")
    )


def _symbols_only_sql() -> str:
    prop = (
        "lambda i: '  p' || CAST(i AS VARCHAR) || CASE WHEN i % 2 = 1 THEN '?' ELSE '' END || ': ' || "
        "CASE i % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' ELSE 'Map<string, number>' END"
    )
    return (
        "so AS (SELECT f.target_dir, f.path, f.p_partkey, f.content, '// symbols-only mode: ' || split_part(f.path, '/', -1) || "
        "coalesce(chr(10) || 'export function ' || fn.name || '(' || fn.params || '): ' || fn.return_type || chr(10) || "
        f"'export interface ' || ifc.name || ' {{' || chr(10) || array_to_string(list_transform(range(f.p_size % 11), {prop}), ';' || chr(10)) "
        "|| chr(10) || '}' || chr(10) || 'export type ' || ty.name || ' = ' || ty.params, '') AS body FROM files f "
        "LEFT JOIN expected fn ON fn.path = f.path AND fn.target_dir = f.target_dir AND fn.kind = 'function' "
        "LEFT JOIN expected ifc ON ifc.path = f.path AND ifc.target_dir = f.target_dir AND ifc.kind = 'interface' "
        "LEFT JOIN expected ty ON ty.path = f.path AND ty.target_dir = f.target_dir AND ty.kind = 'type')"
    )


_READ_SYMBOLS_SQL = (
    f"{_G}, {_symbols_only_sql()} SELECT CAST(p_partkey AS BIGINT) AS request_id, target_dir || '/' || path AS path, body AS content, "
    f"CAST(len(string_split(body, chr(10))) AS INT) AS lines_returned, {S.nlines('content')} AS total_lines, "
    f"{S.tokens('body')} AS token_estimate, 'symbols-only' AS mode, CAST(NULL AS INT) AS error_code, CAST(NULL AS VARCHAR) AS error FROM so"
)


@query("read_symbols_only", _READ_SYMBOLS_SQL)
def q_read_symbols_only(spark, sf):
    files, x = _extraction(spark, sf, ["function", "interface", "type"])
    req = files.select(
        F.col("p_partkey").alias("request_id"), "path", F.col("target_dir").alias("base_dir"),
        F.lit(None).cast("int").alias("max_lines"), F.lit(True).alias("symbols_only"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
    )
    return reads.read_requests(req, files, K.symbols_only_text(x)).select(*reads.READ_COLUMNS)


@query(
    "read_requests_mixed",
    f"SELECT * FROM (WITH {S.docs_files_cte()}, {S.requests_cte()}, {_READS_SQL} SELECT {_READ_COLS} FROM reads) "
    f"UNION ALL SELECT {_READ_COLS} FROM ({_READ_SYMBOLS_SQL})",
)
def q_read_requests_mixed(spark, sf):
    """The requests of ``read_requests`` and a symbols-only one for every file of
    the code corpus, answered from both corpora together: only files that a
    symbols-only request names are parsed."""
    code = _code(spark, sf)
    asked = R.read_requests_table(spark, sf)
    more = code.select(
        F.col("p_partkey").alias("request_id"), F.lit(0).alias("session_id"), "path", F.col("target_dir").alias("base_dir"),
        F.lit(None).cast("int").alias("max_lines"), F.lit(True).alias("symbols_only"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
    )
    cols = ["target_dir", "path", "content"]
    files = _docs(spark, sf).select(*cols).unionByName(code.select(*cols))
    asked = asked.unionByName(more)
    bodies = K.symbols_bodies(reads.symbols_wanted(asked, files))
    return reads.read_requests(asked, files, bodies).select(*reads.READ_COLUMNS)


_MOCK_SQL = (
    "idx AS (SELECT DISTINCT target_dir, path FROM expected), "
    "picked AS (SELECT * FROM (SELECT i.target_dir, i.path, row_number() OVER (PARTITION BY i.target_dir ORDER BY i.path) AS rn "
    "FROM idx i) WHERE rn <= 2), "
    "mock AS (SELECT p.target_dir, p.path, array_to_string(list_slice(string_split(f.content, chr(10)), 1, 300), chr(10)) AS content "
    "FROM picked p JOIN files f ON p.target_dir = f.target_dir AND p.path = f.path)"
)


def _mock_reads(files, declared):
    """``declared``: files with an exported declaration, in any columns more."""
    indexed = files.join(declared.select("target_dir", "path").distinct(), ["target_dir", "path"], "left_semi")
    return reads.first_lines_preview(indexed)


@query("mock_reads", f"{_G}, {_MOCK_SQL} SELECT target_dir, path, content, {S.tokens('content')} AS token_estimate FROM mock")
def q_mock_reads(spark, sf):
    files = _code(spark, sf)
    return _mock_reads(files, _declared(files))


_SB_CTES = (
    f"{_MOCK_SQL}, rd AS (SELECT target_dir, count(*) AS n, sum({S.tokens('content')}) AS t FROM mock GROUP BY target_dir), "
    f"nv AS (SELECT target_dir, sum({S.tokens('content')}) AS naive FROM files_sized WHERE {S.naive_scope()} GROUP BY target_dir), "
    "sb AS (SELECT nv.target_dir, CAST(coalesce(t.files_indexed, 0) AS BIGINT) AS files_indexed, CAST(coalesce(t.skeleton_tokens, 0) AS BIGINT) AS skeleton_tokens, "
    "CAST(coalesce(rd.n, 0) AS BIGINT) AS files_read_on_demand, CAST(coalesce(rd.t, 0) AS BIGINT) AS file_tokens, "
    "CAST(nv.naive AS BIGINT) AS naive_tokens, CAST(coalesce(t.skeleton_tokens, 0) + coalesce(rd.t, 0) AS BIGINT) AS total_session_tokens, "
    "CASE WHEN coalesce(t.skeleton_tokens, 0) + coalesce(rd.t, 0) > 0 THEN round(nv.naive / (coalesce(t.skeleton_tokens, 0) + coalesce(rd.t, 0)), 2) END AS reduction "
    "FROM nv LEFT JOIN totals t ON nv.target_dir = t.target_dir LEFT JOIN rd ON nv.target_dir = rd.target_dir)"
)


@query("session_budget", f"{_GK}, {_SB_CTES} SELECT * FROM sb")
def q_session_budget(spark, sf):
    files, _, _, entries = _skeleton(spark, sf)
    totals = K.corpus_totals(K.skeleton_text(entries))
    mock = _mock_reads(files, entries)
    return budget.session_budget(totals, mock, budget.naive_tokens(files))


# Query run by ``__spark_entry__.entry``.
FLAGSHIP = "session_budget"


# --------------------------------------------------------------------------
# snapshots: ids, fingerprints, diff, hit test, store, refresh, retention
# --------------------------------------------------------------------------

from skimdex.operators import snapshots as SN  # noqa: E402
from skimdex.session import dealt, materialize, scratch_path  # noqa: E402

# Fixed parameters of the registered snapshot queries (explicit for determinism).
AS_OF = "2024-01-30 23:30:00"
RETAIN = SN.MEMORY_MAX_ENTRIES


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


@query("snapshot_id", f"WITH {S.docs_files_cte()} SELECT DISTINCT target_dir, left(sha256(target_dir), 16) AS target_id FROM files")
def q_snapshot_id(spark, sf):
    return _docs(spark, sf).select("target_dir").distinct().select("target_dir", SN.target_id("target_dir").alias("target_id"))


@query(
    "corpus_fingerprint",
    f"WITH {S.docs_manifest_v1_cte()}, {S.fingerprint_cte('man1', 'fp')} SELECT target_dir, n_files, fingerprint FROM fp",
)
def q_corpus_fingerprint(spark, sf):
    return SN.fingerprints(SN.file_manifest(_docs(spark, sf)))


@query(
    "snapshot_diff",
    f"WITH {S.docs_manifest_v1_cte()}, {S.docs_manifest_v2_cte()} "
    "SELECT coalesce(a.target_dir, b.target_dir) AS target_dir, coalesce(a.path, b.path) AS path, "
    "CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' "
    "WHEN a.size_bytes = b.size_bytes AND a.mtime_ms = b.mtime_ms THEN 'unchanged' ELSE 'changed' END AS status "
    "FROM man1 a FULL OUTER JOIN man2 b ON a.target_dir = b.target_dir AND a.path = b.path",
)
def q_snapshot_diff(spark, sf):
    return SN.diff(SN.file_manifest(_docs(spark, sf)), SN.file_manifest(C.documents_corpus_v2(spark, sf)))


@query(
    "snapshot_hit",
    f"WITH {S.docs_manifest_v1_cte()}, {S.docs_manifest_v2_cte()}, {S.fingerprint_cte('man1', 'fp1')}, {S.fingerprint_cte('man2', 'fp2')} "
    "SELECT c.target_dir, left(sha256(c.target_dir), 16) AS target_id, c.fingerprint, coalesce(s.fingerprint = c.fingerprint, false) AS hit, "
    "CASE WHEN coalesce(s.fingerprint = c.fingerprint, false) THEN 'disk' ELSE 'rebuild' END AS layer "
    "FROM fp2 c LEFT JOIN fp1 s ON c.target_dir = s.target_dir",
)
def q_snapshot_hit(spark, sf):
    stored = SN.fingerprints(SN.file_manifest(_docs(spark, sf))).withColumn("version", F.lit(SN.INDEX_VERSION))
    current = SN.fingerprints(SN.file_manifest(C.documents_corpus_v2(spark, sf)))
    return SN.match_snapshots(current, stored)


def _store(spark, name):
    return SN.SnapshotStore(spark, scratch_path(spark, name))


def _extract_fn(files):
    return Y.extract_symbols(files)


def _written_store(spark, sf, name):
    store = _store(spark, name)
    store.refresh(_code(spark, sf), _extract_fn, _as_of())
    return store


_G_FP = f"{S.code_manifest_cte('files_sized', 'cman')}, {S.fingerprint_cte('cman', 'cfp')}"


@query(
    "snapshot_write",
    f"{_G}, {_G_FP} SELECT left(sha256(target_dir), 16) AS target_id, target_dir, 1 AS version, fingerprint, "
    "CAST(n_files AS BIGINT) AS stored_files FROM cfp",
)
def q_snapshot_write(spark, sf):
    store = _written_store(spark, sf, "write")
    files = store.entries().groupBy("target_id").agg(F.countDistinct("path").alias("stored_files"))
    return store.current().join(files, "target_id", "left").select(
        "target_id", "target_dir", "version", "fingerprint", F.col("stored_files").cast("bigint")
    )


@query(
    "snapshot_load",
    f"{_G} SELECT left(sha256(target_dir), 16) AS target_id, target_dir, path, CAST(ord AS INT) AS ord, kind, name, params, "
    "return_type, docstring FROM expected",
)
def q_snapshot_load(spark, sf):
    store = _written_store(spark, sf, "load")
    return store.symbols().select("target_id", *Y.SYMBOL_COLUMNS)


@query(
    "snapshot_stats",
    f"{_G}, {_G_FP}, asked AS (SELECT DISTINCT target_dir FROM files UNION SELECT DISTINCT '/corpus/' || source FROM documents) "
    "SELECT a.target_dir, left(sha256(a.target_dir), 16) AS target_id, c.fingerprint IS NOT NULL AS exists, c.fingerprint, "
    "CAST(coalesce(c.n_files, 0) AS BIGINT) AS stored_files FROM asked a LEFT JOIN cfp c ON a.target_dir = c.target_dir",
)
def q_snapshot_stats(spark, sf):
    store = _written_store(spark, sf, "stats")
    asked = _code(spark, sf).select("target_dir").unionByName(_docs(spark, sf).select("target_dir"))
    return store.stats(asked)


@query(
    "snapshot_invalidate",
    f"{_G}, {_G_FP} SELECT target_dir, n_files % 2 = 0 AS exists FROM cfp",
)
def q_snapshot_invalidate(spark, sf):
    """Snapshots of targets with an odd number of files are invalidated."""
    store = _written_store(spark, sf, "invalidate")
    counts = SN.file_manifest(_code(spark, sf)).groupBy("target_dir").agg(F.count("*").alias("n"))
    store.invalidate(counts.where(F.col("n") % 2 == 1).select("target_dir"), _as_of() + F.expr("INTERVAL 1 SECOND"))
    return store.stats(counts.select("target_dir")).select("target_dir", "exists")


_REFRESH_SQL = (
    f"WITH {S.code_files_cte('v1')}, {S.code_v2_files_cte('files')}, {S.code_symbols_cte()}, "
    f"{S.code_manifest_cte('files_sized', 'cman', v2=True)}, {S.fingerprint_cte('cman', 'cfp')}, "
    "chg AS (SELECT coalesce(a.target_dir, b.target_dir) AS target_dir, "
    "CASE WHEN b.path IS NULL THEN 'removed' WHEN b.p_size % 10 = 1 THEN 'changed' ELSE 'unchanged' END AS status "
    "FROM v1 a FULL OUTER JOIN files b ON a.target_dir = b.target_dir AND a.p_partkey = b.p_partkey), "
    "cnt AS (SELECT target_dir, count(*) FILTER (WHERE status = 'changed') AS ex, count(*) FILTER (WHERE status = 'unchanged') AS re, "
    "count(*) FILTER (WHERE status = 'removed') AS rm FROM chg GROUP BY target_dir), "
    "idx AS (SELECT target_dir, count(DISTINCT path) AS n FROM expected GROUP BY target_dir) "
    "SELECT f.target_dir, left(sha256(f.target_dir), 16) AS target_id, (c.ex + c.rm = 0) AS hit, "
    "CASE WHEN c.ex + c.rm = 0 THEN 'disk' ELSE 'rebuild' END AS layer, f.fingerprint, CAST(coalesce(i.n, 0) AS BIGINT) AS files_indexed, "
    "CAST(CASE WHEN c.ex + c.rm = 0 THEN 0 ELSE c.ex END AS BIGINT) AS files_extracted, "
    "CAST(CASE WHEN c.ex + c.rm = 0 THEN 0 ELSE c.re END AS BIGINT) AS files_reused, "
    "CAST(CASE WHEN c.ex + c.rm = 0 THEN 0 ELSE c.rm END AS BIGINT) AS files_removed "
    "FROM cfp f JOIN cnt c ON f.target_dir = c.target_dir LEFT JOIN idx i ON f.target_dir = i.target_dir"
)


@query("snapshot_refresh", _REFRESH_SQL)
def q_snapshot_refresh(spark, sf):
    """Index v1 of the code corpus, then refresh against v2: only changed files
    are extracted, unchanged ones are reused, removed ones drop out."""
    store = _written_store(spark, sf, "refresh")
    return store.refresh(C.code_corpus_v2(spark, sf), _extract_fn, _as_of() + F.expr("INTERVAL 1 SECOND"))


@query(
    "snapshot_retention",
    "SELECT event_type, user_id, last_access_at, rank FROM (SELECT event_type, user_id, max(ts) AS last_access_at, "
    "row_number() OVER (PARTITION BY event_type ORDER BY max(ts) DESC, user_id) AS rank FROM events GROUP BY event_type, user_id) "
    f"WHERE rank <= {RETAIN}",
)
def q_snapshot_retention(spark, sf):
    ev = C.table(spark, sf, "events").select("event_type", "user_id", "ts")
    return SN.retention(ev, "event_type", "user_id", "ts", RETAIN).select(
        "event_type", "user_id", "last_access_at", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "snapshot_fresh",
    "SELECT user_id, event_type, set_at, set_at + INTERVAL 15 MINUTE AS expires_at, "
    f"TIMESTAMP '{AS_OF}' <= set_at + INTERVAL 15 MINUTE AS fresh "
    "FROM (SELECT user_id, event_type, max(ts) AS set_at FROM events GROUP BY user_id, event_type)",
)
def q_snapshot_fresh(spark, sf):
    ev = C.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("set_at"))
    return SN.freshness(ev, "set_at", F.lit(AS_OF).cast("timestamp_ntz")).select(
        "user_id", "event_type", "set_at", "expires_at", "fresh"
    )


# --------------------------------------------------------------------------
# budget log (JSON sink and source) and the two streams
# --------------------------------------------------------------------------

from skimdex.sources import budget_log as BL  # noqa: E402
from skimdex.streaming import reads as SR  # noqa: E402
from skimdex.streaming import upkeep as SU  # noqa: E402


def _g_budget(spark, sf):
    files, _, _, entries = _skeleton(spark, sf)
    totals = K.corpus_totals(K.skeleton_text(entries))
    return files, budget.session_budget(totals, _mock_reads(files, entries), budget.naive_tokens(files))


def _g_log_records(spark, sf):
    files, sb = _g_budget(spark, sf)
    cache = SN.match_snapshots(SN.fingerprints(SN.file_manifest(files)), spark.createDataFrame([], "target_dir string, version int, fingerprint string"))
    return BL.log_records(sb, _as_of(), BL.MODE_MOCK, cache=cache)


_LOG_COLS = ", ".join(BL.LOG_COLUMNS)
_G_LOG_SQL = (
    f"glog AS (SELECT TIMESTAMP '{AS_OF}' AS ts, target_dir, files_indexed, skeleton_tokens, naive_tokens, total_session_tokens, "
    "files_read_on_demand, file_tokens, true AS index_cache_enabled, false AS index_cache_hit, left(sha256(target_dir), 16) || '.json' AS index_cache_file, "
    f"'{BL.DEFAULT_QUESTION}' AS question, '{BL.MODE_MOCK}' AS mode FROM sb)"
)


@query("budget_log_append", f"{_GK}, {_SB_CTES}, {_G_LOG_SQL} SELECT {_LOG_COLS} FROM glog")
def q_budget_log_append(spark, sf):
    log_dir = scratch_path(spark, "budget-log")
    BL.append_log(_g_log_records(spark, sf), log_dir)
    return BL.read_log(spark, log_dir)


def _old_log_sql() -> str:
    return (
        f"WITH {S.docs_files_cte()} SELECT TIMESTAMP '{AS_OF}' AS ts, target_dir, CAST(0 AS BIGINT) AS files_indexed, "
        "CAST(0 AS BIGINT) AS skeleton_tokens, CAST(sum(" + S.tokens("content") + ") AS BIGINT) AS naive_tokens, CAST(0 AS BIGINT) AS total_session_tokens, "
        "CAST(0 AS BIGINT) AS files_read_on_demand, CAST(0 AS BIGINT) AS file_tokens, CAST(NULL AS BOOLEAN) AS index_cache_enabled, "
        "CAST(NULL AS BOOLEAN) AS index_cache_hit, CAST(NULL AS VARCHAR) AS index_cache_file, "
        f"'{BL.DEFAULT_QUESTION}' AS question, '{BL.MODE_HANDOFF}' AS mode FROM files WHERE {S.naive_scope()} GROUP BY target_dir"
    )


@query(
    "budget_log_read",
    f"SELECT * FROM ({_old_log_sql()}) UNION ALL SELECT * FROM ({_GK}, {_SB_CTES}, {_G_LOG_SQL} SELECT {_LOG_COLS} FROM glog)",
)
def q_budget_log_read(spark, sf):
    """A log holding records of the old shape (no cache fields: handoff runs
    over the documents corpus) and of the new shape (mock runs over the code
    corpus), read back with the explicit nullable schema."""
    log_dir = scratch_path(spark, "budget-log")
    naive = budget.naive_tokens(_docs(spark, sf))
    zeros = naive.select(
        "target_dir", F.lit(0).alias("files_indexed"), F.lit(0).alias("skeleton_tokens"), "naive_tokens",
        F.lit(0).alias("total_session_tokens"), F.lit(0).alias("files_read_on_demand"), F.lit(0).alias("file_tokens"),
    )
    BL.append_log(BL.log_records(zeros, _as_of(), BL.MODE_HANDOFF), log_dir)
    BL.append_log(_g_log_records(spark, sf), log_dir)
    return BL.read_log(spark, log_dir)


_STREAM_READS_SQL = (
    f"WITH {S.docs_files_cte()}, {S.payloads_cte()}, {_COERCE_SQL}, {_VALIDATE_SQL}, "
    "req AS (SELECT request_id, session_id, path, base_dir, max_lines, symbols_only, line_start, line_end FROM validated WHERE error_code IS NULL AND tool = 'read_file'), "
    f"{_READS_SQL} SELECT {_READ_COLS}, session_id FROM reads UNION ALL "
    "SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, CAST(error_code AS INT), error, session_id FROM validated WHERE error_code IS NOT NULL"
)


@query("stream_read_requests", _STREAM_READS_SQL)
def q_stream_read_requests(spark, sf):
    """Payloads land as parquet files; a file-source stream (available-now
    trigger) answers them into a parquet sink."""
    base = scratch_path(spark, "stream-reads")
    R.request_payloads(spark, sf).write.parquet(f"{base}/in")
    q = SR.start(spark, f"{base}/in", _docs(spark, sf), f"{base}/out", f"{base}/chk")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*SR.STREAM_COLUMNS)


@query("stream_read_symbols", _READ_SYMBOLS_SQL)
def q_stream_read_symbols(spark, sf):
    """A symbols-only call for every file of the code corpus, as a stream of
    payloads; each micro-batch parses the files it asks for."""
    base = scratch_path(spark, "stream-symbols")
    files = _code(spark, sf)
    args = F.struct("path", F.col("target_dir").alias("baseDir"), F.lit(True).alias("symbolsOnly"))
    payload = F.to_json(F.struct(F.lit("read_file").alias("name"), args.alias("arguments")))
    files.select(
        F.col("p_partkey").cast("bigint").alias("request_id"), F.lit(0).cast("bigint").alias("session_id"), payload.alias("payload")
    ).write.parquet(f"{base}/in")
    SR.start(spark, f"{base}/in", files, f"{base}/out", f"{base}/chk", symbols_for=K.symbols_bodies).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*reads.READ_COLUMNS)


def _v2_expected_sql() -> str:
    return (
        f"{_G}, e2 AS (SELECT e.*, g.p_size, g.p_partkey FROM expected e JOIN g ON e.target_dir = g.target_dir AND e.path = g.path), "
        "v2 AS (SELECT target_dir, path, CAST(CASE WHEN p_size % 10 = 1 AND ord >= 2 THEN ord + 1 ELSE ord END AS INT) AS ord, kind, name, params, "
        "return_type, docstring FROM e2 WHERE p_size % 10 <> 9 UNION ALL SELECT target_dir, path, 2, 'function', "
        "'extra' || CAST(p_partkey AS VARCHAR), '', 'void', NULL FROM g WHERE p_size % 10 = 1) "
    )


@query("stream_index_upkeep", _v2_expected_sql() + "SELECT target_dir, path, ord, kind, name, params, return_type, docstring FROM v2")
def q_stream_index_upkeep(spark, sf):
    """Index v1 of the code corpus, then stream the v1 -> v2 file changes into
    it (edits and deletions), then older copies of the edited and the deleted
    files, which must be ignored."""
    store = _written_store(spark, sf, "upkeep")
    v1, v2 = SN.file_manifest(_code(spark, sf)), C.code_corpus_v2(spark, sf)
    changed = SN.diff(v1, SN.file_manifest(v2)).where(F.col("status") != "unchanged")
    edits = v2.join(changed, ["target_dir", "path"], "left_semi").select(
        "target_dir", "path", "content", "size_bytes", "mtime", F.lit(False).alias("deleted")
    )
    gone = _code(spark, sf).join(changed.where(F.col("status") == "removed"), ["target_dir", "path"], "left_semi").select(
        "target_dir", "path", F.lit(None).cast("string").alias("content"), F.lit(None).cast("bigint").alias("size_bytes"),
        "mtime", F.lit(True).alias("deleted"),
    )
    stale = edits.unionByName(gone).select(
        "target_dir", "path", F.lit("export function stale(): void {}").alias("content"), F.lit(33).cast("bigint").alias("size_bytes"),
        (F.col("mtime") - F.expr(f"INTERVAL {2 * C.EDIT_SECONDS} SECONDS")).alias("mtime"), F.lit(False).alias("deleted"),
    )
    base = scratch_path(spark, "stream-upkeep")
    for rows in (edits.unionByName(gone), stale):
        rows.write.mode("append").parquet(f"{base}/in")
        SU.start(spark, f"{base}/in", store, _extract_fn, f"{base}/chk", _as_of(), max_files_per_trigger=None).awaitTermination()
    return store.symbols().select(*Y.SYMBOL_COLUMNS)


# --------------------------------------------------------------------------
# directory trees (Python Data Source)
# --------------------------------------------------------------------------

from skimdex.sources import directory as D  # noqa: E402


@query(
    "scan_directory",
    f"WITH {S.docs_files_cte()} SELECT target_dir, path, size_bytes FROM files WHERE {S.indexable()}",
)
def q_scan_directory(spark, sf):
    """The documents corpus written out as a real tree (one folder per target)
    and listed with pruning and scope rules applied during the walk; no file is opened."""
    root = scratch_path(spark, "tree")
    D.write_tree(_docs(spark, sf), root)
    tree = D.directory_listing(spark, root, scope="indexable", targets="children")
    return tree.select(
        F.concat(F.lit("/corpus/"), F.element_at(F.split("target_dir", "/"), -1)).alias("target_dir"), "path", "size_bytes"
    )


@query(
    "scan_binary",
    f"WITH {S.docs_files_cte()} SELECT replace(target_dir, '/corpus/', '') || '/' || path AS path, size_bytes, {S.tokens('content')} AS token_estimate, "
    f"CAST(NULL AS VARCHAR) AS error FROM files WHERE {S.indexable()} AND path NOT LIKE '.%'",
)
def q_scan_binary(spark, sf):
    """The same tree read by Spark's ``binaryFile`` reader (hidden names are its gap)."""
    root = scratch_path(spark, "tree")
    D.write_tree(_docs(spark, sf), root)
    tree = D.binary_corpus(spark, root)
    return tree.select("path", "size_bytes", T.token_estimate("content").cast("bigint").alias("token_estimate"), "error")


# --------------------------------------------------------------------------
# index tools
# --------------------------------------------------------------------------

from skimdex.operators import index_tools as IT  # noqa: E402
from skimdex.streaming import index_tools as SI  # noqa: E402

_INDEX_CALLS_SQL = (
    f"{_GK}, {_G_FP}, calls AS (SELECT CAST(o.o_orderkey AS BIGINT) AS request_id, o.o_custkey, CAST(o.o_orderkey % 7 AS INT) AS k, "
    "coalesce('/repo/' || lower(p.p_type), '/repo/none') AS target_dir FROM orders o LEFT JOIN part p ON o.o_custkey = p.p_partkey), "
    "seen AS (SELECT *, coalesce(last_value(CASE WHEN k IN (0, 1, 2) THEN true WHEN k = 3 THEN false END IGNORE NULLS) OVER "
    "(PARTITION BY target_dir ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM calls WHERE k <> 6), "
    "ans AS (SELECT s.request_id, CASE WHEN k < 3 THEN 'repo_index' WHEN k = 3 THEN 'index_cache_invalidate' ELSE 'index_cache_stats' END AS tool, "
    "s.target_dir, CASE WHEN k < 3 THEN before AND k <> 1 END AS hit, "
    "CASE WHEN k < 3 THEN CASE WHEN before AND k <> 1 THEN 'disk' ELSE 'rebuild' END END AS layer, CASE WHEN k < 3 THEN f.fingerprint END AS fingerprint, "
    "CASE WHEN k < 3 THEN coalesce(t.files_indexed, 0) END AS files_indexed, CASE WHEN k < 3 THEN coalesce(t.skeleton_tokens, 0) END AS skeleton_tokens, "
    "CASE WHEN k = 3 THEN true END AS index_cache_invalidated, CASE WHEN k = 3 THEN o_custkey % 2 = 0 END AS read_file_cache_cleared, "
    "CASE WHEN k > 3 THEN left(sha256(s.target_dir), 16) END AS cache_id, CASE WHEN k > 3 THEN before END AS \"exists\", "
    "CAST(NULL AS INT) AS error_code, CAST(NULL AS VARCHAR) AS error "
    "FROM seen s LEFT JOIN cfp f ON f.target_dir = s.target_dir LEFT JOIN totals t ON t.target_dir = s.target_dir "
    "UNION ALL SELECT request_id, 'repo_index', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, -32602, 'repo_index requires targetDir' FROM calls WHERE k = 6) "
    "SELECT * FROM ans"
)


def _index_targets(spark, sf):
    files, _, _, entries = _skeleton(spark, sf)
    return materialize(IT.index_targets(SN.file_manifest(files), K.corpus_totals(K.skeleton_text(entries))), "index-targets")


@query("index_tools", _INDEX_CALLS_SQL)
def q_index_tools(spark, sf):
    """Answers to repo_index (cache block included), invalidation and stats calls, each
    after the calls before it on its target."""
    return IT.answer(R.index_payloads(spark, sf), _index_targets(spark, sf), spark.createDataFrame([], IT.STATE_SCHEMA))[0]


@query("stream_index_tools", _INDEX_CALLS_SQL)
def q_stream_index_tools(spark, sf):
    """The same calls as a stream of three micro-batches with state between them: each
    third of the calls comes as files of many tasks, and the stream goes on with it."""
    root = scratch_path(spark, "index-tools")
    calls = materialize(dealt(R.index_payloads(spark, sf), "request_id"), "index-payloads")
    bounds = calls.approxQuantile("request_id", [1 / 3, 2 / 3], 0.01)
    targets = _index_targets(spark, sf)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = calls.where((F.lit(low).isNull() | (F.col("request_id") > F.lit(low))) & (F.lit(high).isNull() | (F.col("request_id") <= F.lit(high))))
        part.write.mode("append").parquet(f"{root}/in")
        SI.start(spark, f"{root}/in", targets, root).awaitTermination()
    return SI.answers(spark, root)
