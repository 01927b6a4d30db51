"""Bounded reads: many read requests answered by one join against the corpus.

``requests(request_id, path, base_dir, max_lines, symbols_only, line_start,
line_end)`` is joined to ``files`` on the normalised absolute path and one
``select`` dispatches each row to a mode, in the reference's precedence:
symbols-only > line range > full (lines <= cap) > capped.

Errors are rows, not exceptions: ``error_code`` -32603 with the reference's
messages. Check order: a path outside its base is refused first (before the
lookup), then missing file, then binary (NUL) content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.functions import text as T

# Fixed values of the reference behaviour (messages and the capped-read note).
READ_FAILED = -32603
MSG_NOT_FOUND = "File not found: "
MSG_ESCAPES = "Path escapes baseDir: "
MSG_BINARY = "Binary file, cannot read: "
CAPPED_NOTE_HEAD = "\n\n// ... ["
CAPPED_NOTE_TAIL = " more lines, use lineRange to read further]"
SYMBOLS_HEADER = "// symbols-only mode: "

READ_COLUMNS = [
    "request_id", "path", "content", "lines_returned", "total_lines",
    "token_estimate", "mode", "error_code", "error",
]


def js_slice(arr: Column, begin: Column, end: Column) -> Column:
    """JavaScript ``Array.prototype.slice(begin, end)`` on a Spark array:
    negative indexes count from the tail, out-of-range indexes clamp, an empty
    result when end <= begin."""
    n = F.size(arr)
    b = F.when(begin < 0, F.greatest(n + begin, F.lit(0))).otherwise(F.least(begin, n))
    e = F.when(end < 0, F.greatest(n + end, F.lit(0))).otherwise(F.least(end, n))
    return F.slice(arr, b + 1, F.greatest(e - b, F.lit(0)))


def resolve(requests: DataFrame) -> DataFrame:
    """Adds ``file_path`` (base joined with the request path, normalised) and
    ``in_base`` (lexical containment test)."""
    base = P.normalize("base_dir")
    return requests.withColumn("file_path", P.join_path("base_dir", "path")).withColumn(
        "in_base", P.within(F.col("file_path"), base)
    )


def symbols_wanted(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``files`` that a symbols-only request asks for: only these are parsed."""
    wanted = resolve(requests).where(F.col("in_base") & F.col("symbols_only")).select("file_path").distinct()
    return files.join(wanted, F.concat("target_dir", F.lit("/"), "path") == F.col("file_path"), "left_semi")


def read_requests(requests: DataFrame, files: DataFrame, symbols_text: DataFrame | None = None) -> DataFrame:
    """Answer every request; returns ``READ_COLUMNS``.

    ``files`` needs ``target_dir, path, content``. ``symbols_text`` (optional)
    is ``(abs_path, symbols_body)`` from :func:`skimdex.operators.skeleton.symbols_only_text`;
    files without a row there get the header line alone.
    """
    req = resolve(requests)
    corpus = files.select(
        F.concat("target_dir", F.lit("/"), "path").alias("abs_path"), "content"
    )
    # Semi-join reduction: only files someone asked for travel to the request
    # join. The distinct path set is the build side of a left-semi join, so
    # AQE broadcasts it when its measured size allows (the corpus then
    # streams through without a shuffle) and sort-merges otherwise.
    # (Batch requests only: a stream cannot be the build side of that join;
    # a streamed micro-batch is joined to the static corpus directly.)
    if not requests.isStreaming:
        wanted = req.where(F.col("in_base")).select(F.col("file_path").alias("abs_path")).distinct()
        corpus = corpus.join(wanted, "abs_path", "left_semi")
    if symbols_text is not None:
        corpus = corpus.join(symbols_text, "abs_path", "left")
    else:
        corpus = corpus.withColumn("symbols_body", F.lit(None).cast("string"))
    # Only in-base requests look the file up; the others keep their error.
    joined = req.join(
        corpus, (req["file_path"] == corpus["abs_path"]) & req["in_base"], "left"
    )
    return dispatch(joined)


def dispatch(joined: DataFrame) -> DataFrame:
    content = F.col("content")
    lines = T.lines(content)
    total = F.size(lines)
    max_lines = F.coalesce(F.col("max_lines"), F.lit(T.DEFAULT_MAX_LINES))
    has_range = F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    symbols = F.coalesce(F.col("symbols_only"), F.lit(False))

    error = (
        F.when(~F.col("in_base"), F.concat(F.lit(MSG_ESCAPES), "file_path"))
        .when(F.col("abs_path").isNull(), F.concat(F.lit(MSG_NOT_FOUND), "file_path"))
        .when(F.contains(content, F.lit("\u0000")), F.concat(F.lit(MSG_BINARY), "file_path"))
    )
    mode = (
        F.when(symbols, F.lit("symbols-only"))
        .when(has_range, F.lit("line-range"))
        .when(total <= max_lines, F.lit("full"))
        .otherwise(F.lit("capped"))
    )
    range_lines = js_slice(lines, F.col("line_start") - 1, F.col("line_end"))
    capped_text = F.array_join(js_slice(lines, F.lit(0), max_lines), "\n")
    symbols_text = F.concat_ws(
        "\n",
        F.concat(F.lit(SYMBOLS_HEADER), T.basename("file_path")),
        F.col("symbols_body"),
    )
    body = (
        F.when(mode == "symbols-only", symbols_text)
        .when(mode == "line-range", F.array_join(range_lines, "\n"))
        .when(mode == "full", content)
        .otherwise(capped_text)
    )
    shown = F.when(
        mode == "capped",
        F.concat(body, F.lit(CAPPED_NOTE_HEAD), (total - max_lines).cast("string"), F.lit(CAPPED_NOTE_TAIL)),
    ).otherwise(body)
    returned = (
        F.when(mode == "symbols-only", T.line_count(symbols_text))
        .when(mode == "line-range", F.size(range_lines))
        .when(mode == "full", total)
        .otherwise(max_lines)
    )
    ok = error.isNull()
    return joined.select(
        "request_id",
        F.col("file_path").alias("path"),
        F.when(ok, shown).alias("content"),
        F.when(ok, returned).cast("int").alias("lines_returned"),
        F.when(ok, total).cast("int").alias("total_lines"),
        F.when(ok, T.token_estimate(body)).alias("token_estimate"),
        F.when(ok, mode).alias("mode"),
        F.when(~ok, F.lit(READ_FAILED)).cast("int").alias("error_code"),
        error.alias("error"),
        *[c for c in ("session_id",) if c in joined.columns],
    )


def first_lines_preview(files: DataFrame, n_files: int = 2, n_lines: int = T.PREVIEW_LINES) -> DataFrame:
    """Mock-mode reads: the first ``n_files`` indexed paths of each target,
    first ``n_lines`` lines each, no note. ``files`` holds indexed files."""
    from pyspark.sql import Window

    w = Window.partitionBy("target_dir").orderBy("path")
    # Ranked by path alone; only the winners' texts are joined back.
    first = files.select("target_dir", "path").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_files)
    picked = files.join(first, ["target_dir", "path"], "left_semi")
    text = F.array_join(F.slice(T.lines("content"), 1, n_lines), "\n")
    return picked.select(
        "target_dir", "path", text.alias("content"), T.token_estimate(text).alias("token_estimate")
    )
