"""Mixing sources to target weights by hash-threshold histograms.

Sources, in code-point order with null last, weigh 5, 2, 1, repeating, and share
all words; a target stops at `MAX_EPOCHS` times the source's size and the rest is
shared again by weight (a water level). A source whose target is r times its size
takes every document floor(r) times, and once more the documents whose hash lies
below a threshold. The threshold is found without sorting: words are summed by
source and hash bucket, the cumulative sums show the bucket the budget ends in, and
only that bucket is split further, down to single hash values. The hash value at
the boundary is taken if that comes closer to the target. Thresholds of smaller
budgets are nested in those of larger ones.

Defined cases: null or empty text has size 0 and is taken 0 words; null doc_id hashes
as empty; rows that repeat a doc_id share its hash and are taken together; a source of
size 0 has target 0; no rows in, no rows out; a text of any
length is counted whole in its row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.llm.common import WORD_RE, bounded_broadcast, nonnull, stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Bits of the 52-bit hash that each level of the histogram resolves.
LEVELS = (12, 12, 28)
HASH_BITS = sum(LEVELS)


def size_of(text: Column) -> Column:
    return F.regexp_count(nonnull(text), F.lit(WORD_RE)).cast("long")


def hash_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h"))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): one row per source comes in and goes out.

    With sources ordered by the level at which they stop (epochs * size /
    weight), the water level is the one at which those below it have stopped and
    the others share what is left by weight."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        source_sizes.withColumn("weight", weight.cast("long"))
        .withColumn("cap", epochs * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / F.col("open"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    first_free = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)
    return s.withColumn("water", first_free["level"]).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("water") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame, broadcast) -> DataFrame:
    """(source, below): documents of the source with h < below are taken once
    more. ``budgets`` is (source, budget)."""
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    open_rows, seen = rows, 0
    for bits in LEVELS:
        seen += bits
        shift = HASH_BITS - seen
        s = stage(state, "mix")
        hist = (
            open_rows.join(broadcast(s.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
            .filter(F.shiftright("h", shift + bits) == F.col("prefix"))
            .groupBy("source", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("k"), F.first("left").alias("left"))
        )
        order = Window.partitionBy("source").orderBy("bucket")
        cut = (
            hist.withColumn("upto", F.sum("k").over(order))
            .filter(F.col("upto") > F.col("left"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "k", "upto")).alias("b"))
        )
        # No bucket passes the budget (only on the first level): all are taken.
        state = s.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
            F.col("s.source").alias("source"),
            F.when(F.col("b").isNull(), F.col("left")).otherwise(F.col("left") - (F.col("b.upto") - F.col("b.k"))).alias("left"),
            F.when(F.col("b").isNull(), F.shiftleft(F.col("prefix") + 1, bits) - 1).otherwise(F.col("b.bucket")).alias("prefix"),
            F.col("b.k").alias("k"),
        )
    at_boundary = F.col("k").isNull() | (2 * F.col("left") >= F.col("k"))
    return state.select("source", (F.col("prefix") + at_boundary.cast("long")).alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row."""
    rows = stage(sized(docs.select("doc_id", "source", "text")), "sizes")
    per_source = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    plan = stage(targets(per_source, weights, epochs), "targets")
    n = plan.count()
    few = lambda df: bounded_broadcast(df, n, 200)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = stage(thresholds(rows, plan, few), "cuts")
    p = plan.alias("p").join(few(cuts).alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")))
    p = p.select(F.col("p.source").alias("s"), "source_size", "target", "whole", "below")
    copies = F.least(F.col("whole") + (F.col("h") < F.col("below")).cast("long"), F.lit(epochs).cast("long"))
    return rows.join(few(p), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM per_source),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS level
  FROM weighed
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT level AS water FROM levels WHERE level * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, level LIMIT 1),
plan AS (
  SELECT source, source_size, coalesce(least(water * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
  FROM levels LEFT JOIN water ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {MAX_EPOCHS}) ELSE 0 END AS whole
  FROM plan),
ran AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.whole, target - whole * source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS here
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(whole + CASE WHEN upto <= budget OR (upto - here <= budget AND 2 * (budget - (upto - here)) >= here)
                                 THEN 1 ELSE 0 END, {MAX_EPOCHS}) AS BIGINT) AS taken
FROM ran
"""
