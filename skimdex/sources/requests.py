"""Read requests derived from ``orders``: one request per order.

An order asks for the document whose ``doc_id`` equals its ``o_custkey``
(customers without a document ask for a missing file). Columns of the order
pick the read mode and the shape of the path, so every branch of the read
dispatch and of the error rules is exercised at any scale:

* status ``F`` -> plain path, ``O`` -> path with ``.``/``..`` that stays inside
  the base, ``P`` -> path that climbs out of the base;
* priority 1 -> symbols only, 2 -> line range, 3 and 5 -> line cap, 4 -> defaults.

Both a typed table and the JSON tool-call payloads (with wrong types, missing
arguments, unknown tools and broken JSON on some calendar days) are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.sources.corpus import doc_path_sql
from skimdex.sources.tables import table

BASE_DIR = "/corpus"

REQUEST_COLUMNS = ["request_id", "session_id", "path", "base_dir", "max_lines", "symbols_only", "line_start", "line_end"]


def _request_sql() -> dict[str, str]:
    """Portable SQL (Spark and DuckDB) over ``orders o LEFT JOIN documents d``."""
    rel = (
        f"(CASE WHEN d.doc_id IS NULL THEN 'src_missing/doc_' || CAST(o.o_custkey AS STRING) || '.ts' "
        f"ELSE d.source || '/' || {doc_path_sql('d.lang', 'd.doc_id')} END)"
    )
    path = (
        f"(CASE o.o_orderstatus WHEN 'P' THEN '../private/' || {rel} "
        f"WHEN 'O' THEN './' || split_part({rel}, '/', 1) || '/../' || {rel} ELSE {rel} END)"
    )
    pri = "left(o.o_orderpriority, 1)"
    day = "CAST(extract(day FROM o.o_orderdate) AS INT)"
    month = "CAST(extract(month FROM o.o_orderdate) AS INT)"
    return {
        "request_id": "o.o_orderkey",
        "session_id": "o.o_custkey",
        "path": path,
        "base_dir": f"'{BASE_DIR}'",
        "max_lines": f"(CASE {pri} WHEN '3' THEN {day} - 3 WHEN '5' THEN 10 * {month} END)",
        "symbols_only": f"({pri} = '1')",
        "line_start": f"(CASE {pri} WHEN '2' THEN {day} - 1 END)",
        "line_end": f"(CASE {pri} WHEN '2' THEN {day} - 1 + {month} - 4 END)",
        "day": day,
        "month": month,
    }


def requests_select_exprs() -> list[str]:
    e = _request_sql()
    return [
        f"CAST({e[c]} AS {t}) AS {c}"
        for c, t in [
            ("request_id", "BIGINT"),
            ("session_id", "BIGINT"),
            ("path", "STRING"),
            ("base_dir", "STRING"),
            ("max_lines", "INT"),
            ("symbols_only", "BOOLEAN"),
            ("line_start", "INT"),
            ("line_end", "INT"),
        ]
    ]


def requests_sql_select() -> str:
    return ", ".join(requests_select_exprs())


def _orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return o.alias("o").join(d.alias("d"), F.col("o.o_custkey") == F.col("d.doc_id"), "left")


def read_requests_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed requests ``(request_id, session_id, path, base_dir, max_lines,
    symbols_only, line_start, line_end)``."""
    return _orders_docs(spark, sf_dir).selectExpr(*requests_select_exprs())


def payload_sql() -> str:
    """Portable SQL for the JSON tool-call payload of an order."""
    e = _request_sql()
    day, month = e["day"], e["month"]
    pri = "left(o.o_orderpriority, 1)"
    q = lambda x: "'\"' || " + x + " || '\"'"  # noqa: E731  JSON string (paths hold no quotes)
    max_lines = f"(CASE WHEN {month} = 2 THEN {q('CAST(' + e['max_lines'] + ' AS STRING)')} WHEN {month} = 4 THEN '9007199254740991' ELSE CAST({e['max_lines']} AS STRING) END)"
    line_range = (
        f"(CASE WHEN {month} = 2 THEN '[' || CAST({e['line_start']} AS STRING) || ']' "
        f"ELSE '[' || CAST({e['line_start']} AS STRING) || ', ' || CAST({e['line_end']} AS STRING) || ']' END)"
    )
    symbols = f"(CASE WHEN {month} = 2 THEN '\"yes\"' ELSE 'true' END)"
    extras = (
        f"(CASE {pri} WHEN '1' THEN ', \"symbolsOnly\": ' || {symbols} "
        f"WHEN '2' THEN ', \"lineRange\": ' || {line_range} "
        f"WHEN '3' THEN ', \"maxLines\": ' || {max_lines} "
        f"WHEN '5' THEN ', \"maxLines\": ' || {max_lines} ELSE '' END)"
    )
    base = f"(CASE WHEN {day} = 29 THEN '' ELSE ', \"baseDir\": \"{BASE_DIR}\"' END)"
    tool = (
        f"(CASE {day} WHEN 30 THEN 'write_file' WHEN 26 THEN 'repo_index' WHEN 27 THEN 'index_cache_invalidate' "
        "WHEN 28 THEN 'index_cache_stats' ELSE 'read_file' END)"
    )
    flag = f"(CASE WHEN {month} = 2 THEN '\"true\"' ELSE 'true' END)"
    target = (
        f"(CASE WHEN {day} NOT IN (26, 27, 28) OR {month} = 3 THEN '' ELSE ', \"targetDir\": \"{BASE_DIR}\"' END)"
        f" || (CASE {day} WHEN 26 THEN ', \"forceRefresh\": ' || {flag} WHEN 27 THEN ', \"clearReadFileCache\": ' || {flag} ELSE '' END)"
    )
    body = (
        "'{\"name\": \"' || " + tool + " || '\", \"arguments\": {\"path\": ' || " + q(e["path"]) +
        " || " + base + " || " + target + " || " + extras + " || '}}'"
    )
    return f"(CASE WHEN {day} = 31 THEN '{{\"name\": \"read_file\", \"arguments\": {{bad' ELSE {body} END)"


def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, session_id, payload)`` -- raw JSON tool-call arguments."""
    return _orders_docs(spark, sf_dir).selectExpr(
        "CAST(o.o_orderkey AS BIGINT) AS request_id",
        "CAST(o.o_custkey AS BIGINT) AS session_id",
        f"{payload_sql()} AS payload",
    )


def index_payload_sql() -> str:
    """Portable SQL for the payload of an index-tool call of an order; its target is that
    of the part with the customer's number, or one without files."""
    k = "CAST(o.o_orderkey % 7 AS INT)"
    tool = f"(CASE WHEN {k} IN (0, 1, 2, 6) THEN 'repo_index' WHEN {k} = 3 THEN 'index_cache_invalidate' ELSE 'index_cache_stats' END)"
    flags = (
        f"(CASE WHEN {k} = 1 THEN ', \"forceRefresh\": true' WHEN {k} = 2 THEN ', \"forceRefresh\": \"true\"' "
        f"WHEN {k} = 3 AND o.o_custkey % 2 = 0 THEN ', \"clearReadFileCache\": true' ELSE '' END)"
    )
    target = f"(CASE WHEN {k} = 6 THEN 'null' ELSE '\"' || coalesce('/repo/./' || lower(p.p_type), '/repo/none') || '\"' END)"
    return "('{\"name\": \"' || " + tool + " || '\", \"arguments\": {\"targetDir\": ' || " + target + " || " + flags + " || '}}')"


def index_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, session_id, payload)``: calls of the three index tools."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").alias("o")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type").alias("p")
    return o.join(p, F.col("o.o_custkey") == F.col("p.p_partkey"), "left").selectExpr(
        "CAST(o.o_orderkey AS BIGINT) AS request_id", "CAST(o.o_custkey AS BIGINT) AS session_id", f"{index_payload_sql()} AS payload"
    )
