"""Incremental index upkeep from a stream of file changes.

Input rows: ``(target_dir, path, content, size_bytes, mtime, deleted)``. Each
micro-batch (``foreachBatch``):

1. keeps the latest change per file (``row_number`` by mtime, descending; on
   equal times a delete wins, then the greater content);
2. drops late changes: a row older than the stat stored for that file, or an
   edit not newer than the file's last delete (its tombstone), is ignored;
3. extracts symbols of the changed files only;
4. writes the touched targets' new snapshots: stored rows of untouched files +
   new rows, under the new fingerprint. Readers switch with the event appended
   last. Replaying a batch writes the same partitions again, so a retried batch
   after a failure is harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skimdex.operators import snapshots as SN
from skimdex.operators.symbols import SYMBOL_COLUMNS
from skimdex.session import materialize

CHANGE_SCHEMA = "target_dir STRING, path STRING, content STRING, size_bytes BIGINT, mtime TIMESTAMP, deleted BOOLEAN"


def apply_changes(store: SN.SnapshotStore, changes: DataFrame, extract: Callable[[DataFrame], DataFrame], as_of) -> None:
    """Apply one batch of file changes to the store."""
    w = Window.partitionBy("target_dir", "path").orderBy(
        F.col("mtime").desc(), F.col("deleted").desc(), F.col("content").desc_nulls_last()
    )
    latest = changes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    latest = latest.withColumn("mtime_ms", F.unix_millis("mtime")).withColumn("target_id", SN.target_id("target_dir"))
    grave = store.tombstones()
    latest = latest.join(grave, ["target_dir", "path"], "left").where(
        F.col("deleted_ms").isNull() | (F.col("mtime_ms") > F.col("deleted_ms"))
        | (F.col("deleted") & (F.col("mtime_ms") == F.col("deleted_ms")))
    ).drop("deleted_ms")
    stored = store.entries(latest)
    if stored is not None:
        stat = stored.select("target_dir", "path", F.col("size_bytes").alias("stored_size"), F.col("mtime_ms").alias("stored_mtime")).distinct()
        latest = latest.join(stat, ["target_dir", "path"], "left").where(
            F.col("stored_mtime").isNull() | (F.col("mtime_ms") >= F.col("stored_mtime"))
        )
    else:
        latest = latest.withColumns({c: F.lit(None).cast("long") for c in ("stored_size", "stored_mtime")})
    latest = materialize(latest, "upkeep-latest")
    touched = latest.select("target_id").distinct()
    store.append_tombstones(latest.where("deleted").select("target_dir", "path", F.col("mtime_ms").alias("deleted_ms")))
    live = latest.where(~F.col("deleted"))
    new_rows = live.select("target_dir", "path", "size_bytes", "mtime_ms").join(
        extract(live.select("target_dir", "path", "content")), ["target_dir", "path"], "left"
    ).select(*SYMBOL_COLUMNS, *SN.ENTRY_STAT_COLUMNS)
    parts = [new_rows]
    if stored is not None:
        kept = stored.join(touched, "target_id", "left_semi").join(
            latest.select("target_dir", "path"), ["target_dir", "path"], "left_anti"
        )
        parts.append(kept.select(*SYMBOL_COLUMNS, *SN.ENTRY_STAT_COLUMNS))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = materialize(rows, "upkeep-rows")
    # From the sums kept with the last event and the changed files alone; events of an
    # earlier form have no sums, and their targets are summed up anew.
    current = store.current().join(touched, "target_id", "left_semi")
    fps = SN.moved_fingerprints(current.where("lanes is not null"), latest)
    bare = current.where("lanes is null").select("target_dir")
    if not bare.isEmpty():
        whole = SN.lane_sums(rows.select("target_dir", "path", "size_bytes", "mtime_ms").distinct().join(bare, "target_dir", "left_semi"))
        fps = fps.join(bare, "target_dir", "left_anti").unionByName(whole)
    fps = materialize(fps.withColumn("target_id", SN.target_id("target_dir")), "upkeep-fps")
    store.write_entries(rows.join(fps.select("target_dir", "target_id", "fingerprint"), "target_dir"))
    store.append_events(
        fps.select("target_id", "target_dir", F.lit(SN.INDEX_VERSION).alias("version"), "fingerprint",
                   F.lit(SN.EVENT_WRITE).alias("event"), as_of.cast("timestamp").alias("generated_at"), "n_files", "lanes")
    )
    # A touched target with no file left has no snapshot any more.
    emptied = latest.select("target_dir").distinct().join(fps.select("target_dir"), "target_dir", "left_anti")
    store.invalidate(emptied, as_of)


def start(spark: SparkSession, change_dir: str, store: SN.SnapshotStore, extract, checkpoint_dir: str, as_of,
          available_now: bool = True, max_files_per_trigger: int | None = 1) -> StreamingQuery:
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(change_dir)

    def batch(df: DataFrame, batch_id: int) -> None:
        apply_changes(store, df, extract, as_of + F.make_dt_interval(secs=F.lit(batch_id + 1)))

    writer = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
