"""Training-corpus pipeline over `documents`: five stages, each written as Parquet
and read again as the next one's input.

Every stage works on all rows its predecessor kept. Rows that share a doc_id, or have
none, are judged by their own text: they are known by doc_id and 64 bits of the text,
null-safe. Nulls are empty texts; ties go by doc_id, null last; texts of any length stay
in one row; an empty table gives no rows. Other columns than those of `documents` are
dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.llm import exact_dedup, minhash_forest, mixing, packing, quality_rules
from skimdex.llm.common import lookup, nonnull, stage, text_key
from skimdex.session import scratch
from skimdex.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _matching(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text key) is in ``kept``."""
    d, k = docs.withColumn("tk", text_key()).alias("d"), lookup(kept.select("doc_id", "tk"), 32).alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.tk") == F.col("k.tk"))
    return d.join(k, same, "left_semi").select(*[F.col(f"d.{c}") for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _matching(docs, quality_rules.quality_rules(docs).filter("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row that stays."""
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id (null last). A row is
    known by its doc_id; rows that share one, or have none, by doc_id and text, so each
    is judged by its own text, and of equal rows one stays."""
    d = docs.select(*COLUMNS)
    shared = d.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    shared = lookup(shared.select(F.col("doc_id").alias("k"), F.lit(True).alias("shared")), 16)
    own = F.coalesce("shared", F.lit(False))
    d = d.join(shared, F.col("doc_id").eqNullSafe(F.col("k")), "left").select(
        *COLUMNS, own.alias("shared"), F.when(own, F.xxhash64("doc_id", nonnull("text"))).otherwise(F.col("doc_id")).alias("node")
    )
    groups = minhash_forest.near_dedup(d.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    named = groups.distinct().join(d.select("node", "doc_id").distinct(), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.node").alias("k"))
    rows = d.join(lookup(kept, 24), F.col("node") == F.col("k"), "left_semi")
    return rows.filter("not shared").unionByName(rows.filter("shared").dropDuplicates(["node"])).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it leaves out go."""
    copies = mixing.mix(docs).filter(F.col("copies") > 0).select("doc_id", "source", "copies").distinct()
    d, c = docs.alias("d"), lookup(copies, 48).alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source"))
    taken = d.join(c, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.copies"))))
    return taken.select(*[F.col(f"d.{c}") for c in COLUMNS])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of the documents that are left."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash", near), ("mixing", mix), ("packing", pack)]

#: The robust estimates and near-duplicate links have no SQL; tests/llm holds each
#: stage against expected rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage wrote on its way, and the documents it read,
    are removed once its own documents are written."""
    docs, read = table(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, fn in STAGES[:-1]:
        with scratch(spark) as made:
            docs = stage(fn(spark, docs, sf_dir), name)
            written = made.pop()
            made.extend(read)
        read = [written]
    return STAGES[-1][1](spark, docs, sf_dir)
