"""Corpus scoping and per-file text snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.functions import text as T
from skimdex.operators.reads import MSG_BINARY


def scan_indexable(files: DataFrame) -> DataFrame:
    """Files the skeleton covers (pruned dirs out; .ts/.tsx minus typings, tests, specs)."""
    return files.where(P.indexable("path"))


def scan_naive_scope(files: DataFrame) -> DataFrame:
    """Files the load-everything estimate covers (tests and specs stay in)."""
    return files.where(P.naive_scope("path"))


def text_snapshot(files: DataFrame) -> DataFrame:
    """Line count and binary check of each file, as a read would see it."""
    binary = F.contains("content", F.lit("\u0000"))
    return files.select(
        "target_dir",
        "path",
        F.when(~binary, T.line_count("content")).alias("total_lines"),
        binary.alias("is_binary"),
        F.when(binary, F.concat(F.lit(MSG_BINARY), "target_dir", F.lit("/"), "path")).alias("error"),
        "size_bytes",
    )


def domain_scope(files: DataFrame, scopes: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the files that lie in a scope, with their ``domain``: of all
    ``scopes(domain, path_prefix)`` that hold a file the one with the longest prefix
    (whole path segments; '' holds all), of equal ones the least domain.

    Each path is exploded to its prefixes, which meet the scopes in an equi-join: the
    work is the depth of the paths, not files times scopes."""
    depth = F.size(P.segments("path"))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(P.segments("path"), 1, n), "/").alias("path_prefix")))
    held = files.select("target_dir", "path", F.inline(prefixes)).join(scopes.distinct(), "path_prefix")
    best = held.groupBy("target_dir", "path").agg(F.min(F.struct((-F.col("n")).alias("n"), "domain")).alias("best"))
    return files.select("target_dir", "path", *columns).join(best, ["target_dir", "path"]).select("target_dir", "path", *columns, F.col("best.domain").alias("domain"))
