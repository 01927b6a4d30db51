"""Answers to calls of the index tools, each seeing the calls before it.

``repo_index`` is a hit when its target's index is stored and no refresh is forced, else
it builds and stores it; ``index_cache_invalidate`` drops it; ``index_cache_stats`` says
whether it is there. A call's answer needs only the last call before it on its target
that stored or dropped the index, which is carried forward in two levels: calls are dealt
to ranges of (target, request) and written, the last such call of each range (a row for
each range and target) gives what stands before a range, a window inside the range the
rest. No task sees all calls of a target, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.operators import requests as R
from skimdex.operators.snapshots import lane_sums, target_id
from skimdex.session import dealt, materialize

REPO_INDEX, INVALIDATE, STATS = R.TARGET_TOOLS
HIT_LAYER, MISS_LAYER = "disk", "rebuild"
ANSWER_COLUMNS = [
    "request_id", "tool", "target_dir", "hit", "layer", "fingerprint", "files_indexed", "skeleton_tokens",
    "index_cache_invalidated", "read_file_cache_cleared", "cache_id", "exists", "error_code", "error",
]
STATE_SCHEMA = "target_dir string, stored boolean"


def carried(calls: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``before``: whether the target's index was stored when the call came; ``sets``
    is what a call leaves (NULL: nothing). ``state`` holds what earlier calls left."""
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(calls.repartitionByRange(n, "target_dir", "request_id").withColumn("part", F.spark_partition_id()), "index-calls")
    last = F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("request_id")))
    ranges = Window.partitionBy("target_dir").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("target_dir", "part").agg(last.alias("sets"))
    ends = ends.select("target_dir", "part", F.last("sets", ignorenulls=True).over(ranges).alias("of_ranges"))
    inside = Window.partitionBy("target_dir", "part").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    t = ranged.withColumn("of_range", F.last("sets", ignorenulls=True).over(inside)).join(ends, ["target_dir", "part"])
    t = t.join(state.select("target_dir", "stored"), "target_dir", "left")
    return t.withColumn("before", F.coalesce("of_range", "of_ranges", "stored", F.lit(False))).drop("part", "of_range", "of_ranges", "stored")


def left_state(calls: DataFrame, state: DataFrame) -> DataFrame:
    """What all calls so far leave of each target (STATE_SCHEMA)."""
    last = calls.where("sets is not null").groupBy("target_dir").agg(F.max_by("sets", "request_id").alias("sets"))
    return state.join(last, "target_dir", "full").select("target_dir", F.coalesce("sets", "stored").alias("stored"))


def index_calls(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid calls of the index tools, and refused calls, of ``(request_id, payload)``.

    Payloads are dealt over the cluster (a micro-batch, or a table, may be one file),
    read once and written; both results come from what is written."""
    checked = R.validate_requests(R.coerce_requests(dealt(payloads, "request_id")))
    valid, ours = F.col("error_code").isNull(), F.col("tool").isin(*R.TARGET_TOOLS)
    told = materialize(
        checked.where(~valid | ours).select(
            "request_id", "tool", F.when(valid, P.normalize("target_dir")).otherwise(F.col("target_dir")).alias("target_dir"),
            "force_refresh", "clear_read_file_cache",
            F.when(valid & (F.col("tool") == REPO_INDEX), True).when(valid & (F.col("tool") == INVALIDATE), False).alias("sets"),
            "error_code", "error",
        ),
        "calls",
    )
    calls = told.where(valid).drop("error_code", "error")
    return calls, told.where(~valid).select("request_id", "tool", "target_dir", "error_code", "error")


def index_targets(manifest: DataFrame, totals: DataFrame) -> DataFrame:
    """What ``repo_index`` tells of each target: its fingerprint, from the stats of its
    indexable files, and from ``totals`` the files indexed and the skeleton's tokens."""
    fps = lane_sums(manifest).select("target_dir", "fingerprint")
    return fps.join(totals.select("target_dir", "files_indexed", "skeleton_tokens"), "target_dir", "left")


def answer(payloads: DataFrame, targets: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (ANSWER_COLUMNS) and the state that the calls leave. A target without files
    has an empty index without a fingerprint."""
    calls, refused = index_calls(payloads)
    t = carried(calls, state).join(targets, "target_dir", "left")
    of = lambda tool, v: F.when(F.col("tool") == tool, v)
    hit = F.col("before") & ~F.coalesce("force_refresh", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    answered = t.select(
        "request_id", "tool", "target_dir", of(REPO_INDEX, hit).alias("hit"),
        of(REPO_INDEX, F.when(hit, F.lit(HIT_LAYER)).otherwise(F.lit(MISS_LAYER))).alias("layer"), of(REPO_INDEX, F.col("fingerprint")).alias("fingerprint"),
        of(REPO_INDEX, zero("files_indexed")).alias("files_indexed"), of(REPO_INDEX, zero("skeleton_tokens")).alias("skeleton_tokens"),
        of(INVALIDATE, F.lit(True)).alias("index_cache_invalidated"),
        of(INVALIDATE, F.coalesce("clear_read_file_cache", F.lit(False))).alias("read_file_cache_cleared"),
        of(STATS, target_id("target_dir")).alias("cache_id"), of(STATS, F.col("before")).alias("exists"),
        F.lit(None).cast("int").alias("error_code"), F.lit(None).cast("string").alias("error"),
    )
    return answered.unionByName(refused, allowMissingColumns=True).select(*ANSWER_COLUMNS), left_state(calls, state)
