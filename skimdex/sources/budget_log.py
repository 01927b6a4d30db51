"""The token-budget log: append-only JSON records of budget runs.

Written as JSON lines with ``mode("append")`` (old rows are never rewritten);
read back with an explicit nullable schema, so records written before the
``index_cache_*`` fields existed read as NULL there. Logs kept as one JSON
array per file (the reference's format) read with ``multiline=True``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUDGET_LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("target_dir", T.StringType()),
        T.StructField("files_indexed", T.LongType()),
        T.StructField("skeleton_tokens", T.LongType()),
        T.StructField("naive_tokens", T.LongType()),
        T.StructField("total_session_tokens", T.LongType()),
        T.StructField("files_read_on_demand", T.LongType()),
        T.StructField("file_tokens", T.LongType()),
        T.StructField("index_cache_enabled", T.BooleanType()),
        T.StructField("index_cache_hit", T.BooleanType()),
        T.StructField("index_cache_file", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("mode", T.StringType()),
    ]
)
LOG_COLUMNS = BUDGET_LOG_SCHEMA.fieldNames()

# Fixed value of the reference behaviour: the default question.
DEFAULT_QUESTION = "What are the main exported functions and interfaces?"
# Run-mode labels of our records (mock reads included / skeleton handed off).
MODE_MOCK = "mock"
MODE_HANDOFF = "handoff"


def log_records(budget: DataFrame, ts: Column, mode: str, question: str = DEFAULT_QUESTION,
                cache: DataFrame | None = None) -> DataFrame:
    """Budget rows (from :func:`skimdex.operators.budget.session_budget`) as
    log records. ``cache``: optional ``(target_dir, hit, target_id)`` refresh
    status; without it the cache fields are NULL (records of the old shape)."""
    b = budget
    if cache is not None:
        b = b.join(cache.select("target_dir", "hit", "target_id"), "target_dir", "left")
        enabled, hit, file_ = F.lit(True), F.col("hit"), F.concat(F.col("target_id"), F.lit(".json"))
    else:
        enabled = hit = F.lit(None).cast("boolean")
        file_ = F.lit(None).cast("string")
    return b.select(
        ts.cast("timestamp").alias("ts"), "target_dir",
        *[F.col(c).cast("bigint").alias(c) for c in
          ("files_indexed", "skeleton_tokens", "naive_tokens", "total_session_tokens", "files_read_on_demand", "file_tokens")],
        enabled.alias("index_cache_enabled"), hit.alias("index_cache_hit"), file_.alias("index_cache_file"),
        F.lit(question).alias("question"), F.lit(mode).alias("mode"),
    )


def append_log(records: DataFrame, log_dir: str) -> None:
    """Append records; NULL fields are left out of the JSON, as in old records."""
    records.select(*LOG_COLUMNS).write.mode("append").json(log_dir)


def read_log(spark: SparkSession, log_dir: str, multiline: bool = False) -> DataFrame:
    """All records of a log folder (missing fields -> NULL)."""
    return spark.read.schema(BUDGET_LOG_SCHEMA).option("multiLine", multiline).json(log_dir)
