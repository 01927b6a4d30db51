"""Token-budget accounting: load-everything cost against skeleton + reads.

Every figure is a sum of per-file (or per-read) rounded estimates, so all of
them are algebraic aggregates: partial sums are combined map-side and no
group is ever materialised, however large one target is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.functions import text as T
from skimdex.operators.packages import nearest_package
from skimdex.operators.scope import scan_naive_scope


def naive_tokens(files: DataFrame) -> DataFrame:
    """Per target: files in the naive scope and the sum of their per-file
    rounded token estimates."""
    return (
        scan_naive_scope(files)
        .groupBy("target_dir")
        .agg(
            F.count("*").alias("naive_files"),
            F.sum(T.token_estimate("content")).cast("bigint").alias("naive_tokens"),
        )
    )


def session_budget(index_summary: DataFrame, reads: DataFrame, naive: DataFrame) -> DataFrame:
    """One row per target: skeleton tokens, read tokens, total and naive cost.

    ``index_summary``: ``(target_dir, files_indexed, skeleton_tokens)``;
    ``reads``: ``(target_dir, token_estimate)`` of successful reads;
    ``naive``: output of :func:`naive_tokens`.
    """
    read_sums = reads.groupBy("target_dir").agg(
        F.count("*").alias("files_read_on_demand"),
        F.sum("token_estimate").cast("bigint").alias("file_tokens"),
    )
    out = (
        index_summary.join(naive, "target_dir", "full")
        .join(read_sums, "target_dir", "left")
        .select(
            "target_dir",
            F.coalesce("files_indexed", F.lit(0)).cast("bigint").alias("files_indexed"),
            F.coalesce("skeleton_tokens", F.lit(0)).cast("bigint").alias("skeleton_tokens"),
            F.coalesce("files_read_on_demand", F.lit(0)).cast("bigint").alias("files_read_on_demand"),
            F.coalesce("file_tokens", F.lit(0)).cast("bigint").alias("file_tokens"),
            F.coalesce("naive_tokens", F.lit(0)).cast("bigint").alias("naive_tokens"),
        )
    )
    total = F.col("skeleton_tokens") + F.col("file_tokens")
    return out.withColumn("total_session_tokens", total).withColumn(
        "reduction", F.when(total > 0, F.round(F.col("naive_tokens") / total, 2))
    )


def read_accounting(reads: DataFrame) -> DataFrame:
    """Per session: calls, successful reads and their token sum; errors count
    as calls but add no tokens."""
    return reads.groupBy("session_id").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("error").isNull()).alias("files_read"),
        F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("bigint").alias("file_tokens"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


ALL_LEVELS = 1 << 20


def token_rollup(costs: DataFrame) -> DataFrame:
    """Token cost by target, by package and by directory subtree: ``(target_dir,
    package_name, dir, level, files, naive_tokens, skeleton_tokens)`` from
    ``costs(target_dir, path, package_name, naive_tokens, skeleton_tokens)``.

    One pass with grouping sets over files exploded to their ancestor directories, so a
    directory's row covers all below it ('' is the root); ``level`` is the grouping id.
    Targets and packages count each file once, by its row of the root. Sums are combined
    before the shuffle, so a hot directory is one row of each task."""
    below = F.inline(P.ancestors(P.dirname("path"), ALL_LEVELS))
    rows = costs.select("target_dir", "package_name", "naive_tokens", "skeleton_tokens", below).drop("lvl")
    rows = rows.withColumn("root", F.col("dir") == "")
    sets = [["target_dir"], ["target_dir", "package_name"], ["target_dir", "dir"]]
    of_dir = F.grouping("dir") == 0
    measures = {"files": F.lit(1), "naive_tokens": F.col("naive_tokens"), "skeleton_tokens": F.col("skeleton_tokens")}
    sums = [F.sum(F.when(F.col("root"), m)).alias(f"once_{k}") for k, m in measures.items()] + [F.sum(m).alias(f"all_{k}") for k, m in measures.items()]
    g = rows.groupingSets(sets, "target_dir", "package_name", "dir").agg(F.grouping_id().alias("level"), of_dir.alias("of_dir"), *sums)
    pick = [F.when(F.col("of_dir"), F.col(f"all_{k}")).otherwise(F.col(f"once_{k}")).cast("bigint").alias(k) for k in measures]
    return g.select("target_dir", "package_name", "dir", F.col("level").cast("int").alias("level"), *pick)


def file_costs(files: DataFrame, text_rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """What each file of the naive scope costs whole and in the skeleton, with its package."""
    whole = scan_naive_scope(files).select("target_dir", "path", T.token_estimate("content").cast("bigint").alias("naive_tokens"))
    brief = text_rows.select("target_dir", "path", T.token_estimate("text").cast("bigint").alias("skeleton_tokens"))
    both = whole.join(brief, ["target_dir", "path"], "left").withColumn("skeleton_tokens", F.coalesce("skeleton_tokens", F.lit(0).cast("bigint")))
    return nearest_package(both, manifests)
