"""Nearest-manifest package names.

The reference walks from a file's directory upwards (at most six levels) and
takes the first ``package.json`` found; a manifest that has no name, or does
not parse, still ends the walk.

Spark form: resolve per *directory* (far fewer rows than files), as an
equi-join of each directory's ancestor list with the manifests, then
``min_by(name, level)`` -- which keeps a NULL name of the nearest manifest.
Files pick their directory's answer with one more equi-join. Both joins are
left to AQE: a small side is broadcast at run time, a hot key (a huge
directory, the target root) is split by the skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.sources.corpus import manifest_names


def directory_packages(dirs: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(target_dir, dir)`` -> ``(target_dir, dir, package_name)`` for dirs
    that have a manifest among their ancestors."""
    names = manifest_names(manifests).withColumnRenamed("dir", "mdir")
    # inline() names its output after the struct fields (lvl, dir); keep the
    # searched dir apart from the candidate manifest dir.
    cand = dirs.select(
        "target_dir", F.col("dir").alias("src_dir"), F.inline(P.ancestors("dir"))
    ).withColumnRenamed("dir", "mdir")
    hit = cand.join(names, ["target_dir", "mdir"], "inner")
    return hit.groupBy("target_dir", F.col("src_dir").alias("dir")).agg(
        F.min_by("name", "lvl").alias("package_name")
    )


def nearest_package(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(target_dir, path, ...)`` -> adds ``package_name`` (NULL when none)."""
    with_dir = files.withColumn("_dir", P.dirname("path"))
    dirs = with_dir.select("target_dir", F.col("_dir").alias("dir")).distinct()
    pk = directory_packages(dirs, manifests).withColumnRenamed("dir", "_dir")
    return with_dir.join(pk, ["target_dir", "_dir"], "left").drop("_dir")
