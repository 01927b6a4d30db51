"""Skeleton roll-ups: per-file index entries, their prompt text, corpus totals.

The reference renders the whole index as one string. Here the text stays one
row per file (``skeleton_text``); the corpus-wide figures (characters, token
estimate) are algebraic sums over those rows, and the single string is an
opt-in sink (:func:`write_skeleton_text`) that writes the rows in path order
with a range-partitioned sort -- never one giant value in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.functions import text as T
from skimdex.operators.packages import nearest_package
from skimdex.operators.symbols import FILE_KEYS, KIND_RANK, SYMBOL_COLUMNS, declarations, statements, without_overloads
from skimdex.session import materialize

# Fixed values of the reference's prompt format.
CLASS_LABEL = " — methods: "
INDENT = "  "
DOC_PREFIX = "  // "


def js_number(x: Column) -> Column:
    """A double as JavaScript prints it (``2`` not ``2.0``)."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def skeleton_entries(symbols: DataFrame, files: DataFrame | None = None, manifests: DataFrame | None = None) -> DataFrame:
    """``(target_dir, path, size_kb, exports ARRAY<STRUCT>, package_name, suspect)``,
    one row per file with at least one exported signature. Symbols that carry
    ``size_bytes`` need no ``files``."""
    have = symbols.columns
    marked = F.max("suspect") if "suspect" in have else F.lit(False)
    exports = symbols.groupBy(*FILE_KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in SYMBOL_COLUMNS if c not in FILE_KEYS]))).alias("exports"),
        marked.alias("suspect"), *([F.max("size_bytes").alias("size_bytes")] if "size_bytes" in have else []),
    )
    if "size_bytes" not in have:
        exports = exports.join(files.select(*FILE_KEYS, "size_bytes"), FILE_KEYS, "inner")
    entries = exports.withColumn("size_kb", T.size_kb("size_bytes"))
    if manifests is not None:
        entries = nearest_package(entries, manifests)
    else:
        entries = entries.withColumn("package_name", F.lit(None).cast("string"))
    return entries.select(*FILE_KEYS, "size_kb", "exports", "package_name", "suspect")


def signature_line(e: Column) -> Column:
    kind, name, params = e["kind"], e["name"], e["params"]
    line = (
        F.when(kind == "function", F.concat(F.lit(INDENT), name, F.lit("("), params, F.lit("): "), e["return_type"]))
        .when(kind == "interface", F.concat(F.lit(INDENT + "interface "), name, F.lit(" { "), params, F.lit(" }")))
        .when(kind == "class", F.concat(F.lit(INDENT + "class "), name, F.lit(CLASS_LABEL), params))
        .when(kind == "type", F.concat(F.lit(INDENT + "type "), name, F.lit(" = "), params))
        .when(kind == "enum", F.concat(F.lit(INDENT + "enum "), name, F.lit(" { "), params, F.lit(" }")))
    )
    return F.when(e["docstring"].isNotNull(), F.concat(line, F.lit(DOC_PREFIX), e["docstring"])).otherwise(line)


def skeleton_text(entries: DataFrame) -> DataFrame:
    """Per file: its block of the prompt text (header line, one line per export)."""
    pkg = F.when(F.col("package_name").isNotNull() & (F.col("package_name") != ""),
                 F.concat(F.lit(" ["), F.col("package_name"), F.lit("]"))).otherwise(F.lit(""))
    header = F.concat(F.lit('\n"'), F.col("path"), F.lit('"'), pkg, F.lit(" ("), js_number(F.col("size_kb")), F.lit("kb)"))
    body = F.array_join(F.transform("exports", signature_line), "\n")
    return entries.select(*FILE_KEYS, F.concat(header, F.lit("\n"), body).alias("text"))


def corpus_totals(text_rows: DataFrame) -> DataFrame:
    """Per target: files, characters and token estimate of the whole prompt
    text (blocks joined by a newline), as sums -- no string is built."""
    return text_rows.groupBy("target_dir").agg(
        F.count("*").alias("files_indexed"),
        (F.sum(T.utf16_length("text")) + F.count("*") - 1).cast("bigint").alias("skeleton_chars"),
    ).withColumn("skeleton_tokens", F.round(F.col("skeleton_chars") / T.CHARS_PER_TOKEN).cast("bigint"))


def corpus_rows(text_rows: DataFrame) -> DataFrame:
    """The prompt text of each target as ordered rows: ``(target_dir, block_no,
    char_offset, path, text)``. Blocks joined by a newline in the order of ``block_no``
    are the whole text, and each starts at ``char_offset`` (UTF-16 units) in it.

    Prefix sums in two levels: rows are dealt to path ranges and written, so a row's range
    is fixed; totals of the ranges (a row each and target) give what stands before a
    range, a window inside each range the rest. No task sees a whole target."""
    n = int(text_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = text_rows.select("target_dir", "path", "text", (T.utf16_length("text") + 1).cast("bigint").alias("size"))
    t = materialize(t.repartitionByRange(n, "target_dir", "path").withColumn("part", F.spark_partition_id()), "corpus-rows")
    ranges = Window.partitionBy("target_dir").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("target_dir", "part").agg(F.count("*").alias("blocks"), F.sum("size").alias("chars"))
    before = totals.select("target_dir", "part", F.sum("blocks").over(ranges).alias("blocks"), F.sum("chars").over(ranges).alias("chars"))
    inside = Window.partitionBy("target_dir", "part").orderBy("path")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    earlier = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    t = t.select("target_dir", "part", "path", "text", F.row_number().over(inside).alias("at"), zero(earlier).alias("earlier"))
    return t.join(before, ["target_dir", "part"]).select(
        "target_dir", (zero(F.col("blocks")) + F.col("at")).cast("bigint").alias("block_no"),
        (zero(F.col("chars")) + F.col("earlier")).cast("bigint").alias("char_offset"), "path", "text",
    )


def write_skeleton_text(text_rows: DataFrame, out_dir: str) -> None:
    """Opt-in sink: the prompt text of each target, blocks in path order.

    A range-partitioned sort orders the rows across tasks; each output file
    holds a contiguous run of paths (file names sort in that order)."""
    (
        text_rows.repartitionByRange("target_dir", "path")
        .sortWithinPartitions("target_dir", "path")
        .select("target_dir", "text")
        .write.mode("overwrite")
        .partitionBy("target_dir")
        .text(out_dir)
    )


def symbols_bodies(files: DataFrame) -> DataFrame:
    """:func:`symbols_only_text` of ``files``, in or out of the index scope."""
    pieces = statements(files.where(F.contains("content", F.lit("export"))))
    return symbols_only_text(declarations(pieces, ["function", "interface", "type"]))


def symbols_only_text(decls: DataFrame) -> DataFrame:
    """Per file: the lines a symbols-only read returns after its header --
    exported functions, then interfaces with all their properties, then type
    aliases; no classes, no enums. Returns ``(abs_path, symbols_body)``."""
    d = without_overloads(decls.where(F.col("kind").isin("function", "interface", "type")))
    kind, name, params = F.col("kind"), F.col("name"), F.col("params")
    props = F.array_join(F.transform("props", lambda p: F.concat(F.lit(INDENT), p)), ";\n")
    line = (
        F.when(kind == "function", F.concat(F.lit("export function "), name, F.lit("("), params, F.lit("): "), "return_type"))
        .when(kind == "interface", F.concat(F.lit("export interface "), name, F.lit(" {\n"), props, F.lit("\n}")))
        .otherwise(F.concat(F.lit("export type "), name, F.lit(" = "), params))
    )
    grp = F.when(kind == "function", KIND_RANK["function"]).when(kind == "interface", KIND_RANK["interface"]).otherwise(KIND_RANK["type"])
    lines = F.array_sort(F.collect_list(F.struct(grp.alias("grp"), "pos", line.alias("line"))))
    return d.groupBy(*FILE_KEYS).agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("symbols_body")).select(
        F.concat("target_dir", F.lit("/"), "path").alias("abs_path"), "symbols_body"
    )
