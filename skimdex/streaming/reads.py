"""Streamed read requests: tool-call payloads in, read results out.

A file-source stream of payload records is coerced and validated (the same
expressions as the batch path), valid calls are answered by a stream-static
left join with the corpus, invalid ones become error rows; both go to an
append-only parquet sink with a checkpoint, so a restarted query resumes
exactly where it stopped.

Symbols-only bodies need the files asked for parsed. With ``symbols_for`` each
micro-batch is therefore answered as a batch job over the requested files alone
and written to ``batch=<id>`` under the output folder, which a retry overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skimdex.operators import reads, requests

PAYLOAD_SCHEMA = "request_id BIGINT, session_id BIGINT, payload STRING"
STREAM_COLUMNS = reads.READ_COLUMNS + ["session_id"]


def answer(payloads: DataFrame, files: DataFrame, symbols_for: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Batch or streaming ``(request_id, session_id, payload)`` -> read rows.

    ``symbols_for(files) -> (abs_path, symbols_body)`` (batches only) parses the
    files that symbols-only calls name; without it those get the header line."""
    checked = requests.validate_requests(requests.coerce_requests(payloads))
    # Calls of the index tools are valid, but nothing is read for them.
    ok = checked.where(F.col("error_code").isNull() & (F.col("tool") == requests.TOOL_READ)).select(
        "request_id", "session_id", "path", "base_dir", "max_lines", "symbols_only", "line_start", "line_end"
    )
    symbols_text = symbols_for(reads.symbols_wanted(ok, files)) if symbols_for else None
    answered = reads.read_requests(ok, files, symbols_text).select(*STREAM_COLUMNS)
    refused = checked.where(F.col("error_code").isNotNull()).select(
        "request_id",
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("int").alias("lines_returned"),
        F.lit(None).cast("int").alias("total_lines"),
        F.lit(None).cast("bigint").alias("token_estimate"),
        F.lit(None).cast("string").alias("mode"),
        "error_code",
        "error",
        "session_id",
    )
    return answered.unionByName(refused)


def start(spark: SparkSession, payload_dir: str, files: DataFrame, out_dir: str, checkpoint_dir: str,
          available_now: bool = True, max_files_per_trigger: int | None = None,
          symbols_for: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` drains what is there and stops."""
    reader = spark.readStream.schema(PAYLOAD_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(payload_dir)
    if symbols_for:
        def batch(df: DataFrame, batch_id: int) -> None:
            answer(df, files, symbols_for).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

        writer = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    else:
        writer = (
            answer(src, files).writeStream.format("parquet")
            .option("path", out_dir)
            .option("checkpointLocation", checkpoint_dir)
            .outputMode("append")
        )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
