"""Calls of the index tools as a stream: every call sees all calls before it.

Each micro-batch is answered by the batch operator from the state that the batch before
it left. Answers and state of a batch are written to folders named by its number, so a
batch that is run again reads the same state and overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skimdex.operators import index_tools as I
from skimdex.streaming.reads import PAYLOAD_SCHEMA


def _state(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], I.STATE_SCHEMA)
    return spark.read.schema(I.STATE_SCHEMA).parquet(f"{root}/state/batch={batch_id - 1}")


def start(spark: SparkSession, payload_dir: str, targets: DataFrame, root: str, available_now: bool = True,
          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Answers go to ``root/answers/batch=<n>``, state to ``root/state/batch=<n>``."""
    reader = spark.readStream.schema(PAYLOAD_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def batch(df: DataFrame, batch_id: int) -> None:
        answers, state = I.answer(df, targets, _state(spark, root, batch_id))
        answers.write.mode("overwrite").parquet(f"{root}/answers/batch={batch_id}")
        state.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    writer = reader.parquet(payload_dir).writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def answers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/answers").select(*I.ANSWER_COLUMNS)
