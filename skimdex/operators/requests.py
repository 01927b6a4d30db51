"""Tool-call payloads to typed read requests: argument coercion and validation.

A payload is the JSON object ``{"name": tool, "arguments": {...}}``. Each
argument is accepted only when its JSON type is the expected one (a string
``"3"`` is not a number); otherwise it is NULL and the default applies. The
payload is parsed once into a VARIANT; types are read with
``schema_of_variant``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference behaviour: JSON-RPC error codes and messages.
PARSE_ERROR = -32700
METHOD_NOT_FOUND = -32601
INVALID_PARAMS = -32602
MSG_PARSE = "Parse error"
MSG_NO_TOOL = "Missing tool name"
MSG_READ_ARGS = "read_file requires path and baseDir"
MSG_UNKNOWN_TOOL = "Unknown tool: "
MSG_NEEDS_TARGET = " requires targetDir"
TOOL_READ = "read_file"
TARGET_TOOLS = ("repo_index", "index_cache_invalidate", "index_cache_stats")
MAX_INT = 2**31 - 1

_NUMERIC = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(_field(v, path))


def _as_string(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _as_int(v: Column, path: str) -> Column:
    """A number of any size, clamped to what a line count can be."""
    number = F.least(F.greatest(F.try_variant_get(v, path, "double"), F.lit(float(-MAX_INT - 1))), F.lit(float(MAX_INT)))
    return F.when(_type(v, path).rlike(_NUMERIC), number.cast("int"))


def _as_bool(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with the columns ``made``, which come out of a generator: else filters on
    them, and each expression that names one more than once, compute them again."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def coerce_requests(payloads: DataFrame) -> DataFrame:
    """``(request_id, payload, ...)`` -> typed arguments; NULL where the JSON
    type is wrong or the payload is not JSON (``valid_json`` false)."""
    keep = [c for c in payloads.columns if c != "payload"]
    parsed = _once(payloads, _v=F.try_parse_json("payload"))
    v, rng = F.col("_v"), "$.arguments.lineRange"
    arr = F.try_variant_get(v, rng, "array<variant>")
    pair_ok = (
        F.startswith(_type(v, rng), F.lit("ARRAY"))
        & (F.size(arr) == 2)
        & _type(v, rng + "[0]").rlike(_NUMERIC)
        & _type(v, rng + "[1]").rlike(_NUMERIC)
    )
    typed = {
        "valid_json": v.isNotNull(),
        "tool": _as_string(v, "$.name"),
        "path": _as_string(v, "$.arguments.path"),
        "base_dir": _as_string(v, "$.arguments.baseDir"),
        "max_lines": _as_int(v, "$.arguments.maxLines"),
        "symbols_only": _as_bool(v, "$.arguments.symbolsOnly"),
        "line_start": F.when(pair_ok, _as_int(v, rng + "[0]")),
        "line_end": F.when(pair_ok, _as_int(v, rng + "[1]")),
        "target_dir": _as_string(v, "$.arguments.targetDir"),
        "force_refresh": _as_bool(v, "$.arguments.forceRefresh"),
        "clear_read_file_cache": _as_bool(v, "$.arguments.clearReadFileCache"),
    }
    return _once(parsed, **typed).select(*keep, *typed)


def validate_requests(coerced: DataFrame) -> DataFrame:
    """Adds ``error_code`` / ``error`` for calls that never reach the reader."""
    tool = F.col("tool")
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")  # noqa: E731  JS falsy string
    read_args = (tool == TOOL_READ) & (missing("path") | missing("base_dir"))
    target_args = tool.isin(*TARGET_TOOLS) & missing("target_dir")
    code = (
        F.when(~F.col("valid_json"), F.lit(PARSE_ERROR))
        .when(missing("tool"), F.lit(INVALID_PARAMS))
        .when(~tool.isin(TOOL_READ, *TARGET_TOOLS), F.lit(METHOD_NOT_FOUND))
        .when(read_args | target_args, F.lit(INVALID_PARAMS))
    )
    msg = (
        F.when(~F.col("valid_json"), F.lit(MSG_PARSE))
        .when(missing("tool"), F.lit(MSG_NO_TOOL))
        .when(~tool.isin(TOOL_READ, *TARGET_TOOLS), F.concat(F.lit(MSG_UNKNOWN_TOOL), tool))
        .when(read_args, F.lit(MSG_READ_ARGS))
        .when(target_args, F.concat(tool, F.lit(MSG_NEEDS_TARGET)))
    )
    return coerced.withColumn("error_code", code.cast("int")).withColumn("error", msg)
