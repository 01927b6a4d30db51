"""Index snapshots: fingerprints, change detection and incremental refresh.

Store layout under one root folder on shared storage:

* ``events/``  -- append-only parquet log, one row per write or invalidation:
  ``(target_id, target_dir, version, fingerprint, event, generated_at, seq, n_files,
  lanes)``; ``lanes`` are the sums behind the fingerprint.
  The current state of a target is its event with the highest ``seq``, so
  nothing is ever read and overwritten in the same job.
* ``entries/`` -- the index rows (symbols plus the file stat they were built
  from), partitioned by ``(target_id, fingerprint)``. A refresh writes the new
  fingerprint's partition beside the old one; the event appended after it is
  what switches readers over, so a failure in between leaves the old snapshot
  in place. Partitions of earlier fingerprints are not removed.
* ``tombstones/`` -- ``(target_dir, path, deleted_ms)`` of streamed deletes, so
  an older edit that arrives later does not bring the file back.

The fingerprint is a multiset digest: per file ``sha2(path|size|mtime)``,
summed in four 60-bit lanes per target. Sums are algebraic, so a target with
a third of all files is combined map-side like any other -- no ordered
concatenation of all its files into one task. The sums are kept with the event, so
a changed file's old share is taken off and its new one added, and no other file of
the target is read for the digest (:func:`moved_fingerprints`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions import paths as P
from skimdex.session import materialize
from skimdex.operators.symbols import SYMBOL_COLUMNS

# Fixed values of the reference behaviour.
INDEX_VERSION = 1
TARGET_ID_HEX = 16
MEMORY_TTL_SECONDS = 15 * 60     # index memory cache TTL
MEMORY_MAX_ENTRIES = 64          # index memory cache capacity

EVENT_WRITE = "write"
EVENT_INVALIDATE = "invalidate"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("target_id", T.StringType()),
        T.StructField("target_dir", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("lanes", T.ArrayType(T.DecimalType(38, 0))),
    ]
)
ENTRY_SCHEMA = (
    "target_dir string, path string, ord int, kind string, name string, params string, return_type string, "
    "docstring string, size_bytes bigint, mtime_ms bigint, target_id string, fingerprint string"
)
TOMBSTONE_SCHEMA = "target_dir string, path string, deleted_ms bigint"
ENTRY_STAT_COLUMNS = ["size_bytes", "mtime_ms"]


def target_id(target_dir: Column | str, cache_key: Column | None = None) -> Column:
    """Storage id of a target: first 16 hex digits of sha256(cache key or dir)."""
    d = F.col(target_dir) if isinstance(target_dir, str) else target_dir
    seed = F.coalesce(cache_key, d) if cache_key is not None else d
    return F.left(F.sha2(seed, 256), F.lit(TARGET_ID_HEX))


def file_manifest(files: DataFrame) -> DataFrame:
    """Stat rows of the indexable files: ``(target_dir, path, size_bytes, mtime_ms)``."""
    return files.where(P.indexable("path")).select(
        "target_dir", "path", "size_bytes", F.unix_millis("mtime").alias("mtime_ms")
    )


def _lane(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")


LANES = 4


def _file_lanes(size: str, mtime: str) -> list[Column]:
    h = F.sha2(F.concat_ws("|", "path", F.col(size).cast("string"), F.col(mtime).cast("string")), 256)
    return [_lane(h, i) for i in range(LANES)]


def _digest(sums: DataFrame) -> DataFrame:
    """``(target_dir, n_files, fingerprint, lanes)`` of ``(target_dir, n_files, lanes)``."""
    parts = [F.col("n_files").cast("string"), *[F.get("lanes", i).cast("string") for i in range(LANES)]]
    fp = F.sha2(F.concat_ws("|", F.lit(f"v{INDEX_VERSION}"), "target_dir", *parts), 256)
    return sums.select("target_dir", "n_files", fp.alias("fingerprint"), "lanes")


def lane_sums(manifest: DataFrame) -> DataFrame:
    """Per target: ``n_files``, ``fingerprint`` (hex sha256) and the ``lanes`` it is of."""
    lanes = manifest.select("target_dir", *[v.alias(f"l{i}") for i, v in enumerate(_file_lanes("size_bytes", "mtime_ms"))])
    agg = lanes.groupBy("target_dir").agg(F.count("*").alias("n_files"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(LANES)])
    return _digest(agg.select("target_dir", "n_files", F.array(*[F.col(f"s{i}") for i in range(LANES)]).alias("lanes")))


def fingerprints(manifest: DataFrame) -> DataFrame:
    """Per target: ``n_files`` and ``fingerprint`` (hex sha256)."""
    return lane_sums(manifest).drop("lanes")


def moved_fingerprints(current: DataFrame, changes: DataFrame) -> DataFrame:
    """:func:`lane_sums` of the targets of ``changes`` after them, from the sums of
    ``current`` (target_dir, n_files, lanes) and the changed files alone:
    ``changes(target_dir, path, size_bytes, mtime_ms, deleted, stored_size, stored_mtime)``
    holds each changed file once, with the stat it is stored with (NULL: not stored).
    Targets without a file left have no row."""
    live, stored = ~F.col("deleted"), F.col("stored_mtime").isNotNull()
    zero = F.lit(0).cast("decimal(38,0)")
    share = lambda cond, v: F.when(cond, v).otherwise(zero)
    pairs = zip(_file_lanes("size_bytes", "mtime_ms"), _file_lanes("stored_size", "stored_mtime"))
    moved = changes.select(
        "target_dir", (live.cast("long") - stored.cast("long")).alias("n"),
        *[(share(live, new) - share(stored, old)).cast("decimal(38,0)").alias(f"l{i}") for i, (new, old) in enumerate(pairs)],
    )
    moved = moved.groupBy("target_dir").agg(F.sum("n").alias("n"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(LANES)])
    after = moved.join(current.select("target_dir", "n_files", "lanes"), "target_dir", "left").select(
        "target_dir", (F.coalesce("n_files", F.lit(0)) + F.col("n")).alias("n_files"),
        F.array(*[(F.coalesce(F.get("lanes", i), zero) + F.col(f"s{i}")).cast("decimal(38,0)") for i in range(LANES)]).alias("lanes"),
    )
    return _digest(after.where("n_files > 0"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """File-level change detection between two manifests (full outer join on
    the file key; stats compared null-safely). ``status`` is one of added,
    removed, changed, unchanged."""
    o = old.select("target_dir", "path", F.col("size_bytes").alias("o_size"), F.col("mtime_ms").alias("o_mtime"))
    n = new.select("target_dir", "path", F.col("size_bytes").alias("n_size"), F.col("mtime_ms").alias("n_mtime"))
    j = o.join(n, ["target_dir", "path"], "full")
    status = (
        F.when(F.col("o_size").isNull() & F.col("o_mtime").isNull(), F.lit("added"))
        .when(F.col("n_size").isNull() & F.col("n_mtime").isNull(), F.lit("removed"))
        .when(F.col("o_size").eqNullSafe(F.col("n_size")) & F.col("o_mtime").eqNullSafe(F.col("n_mtime")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return j.select("target_dir", "path", status.alias("status"))


class SnapshotStore:
    """Folder-backed snapshot store (see module docstring)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.events_dir = f"{self.root}/events"
        self.entries_dir = f"{self.root}/entries"
        self.tombstones_dir = f"{self.root}/tombstones"

    # -- reads ---------------------------------------------------------------
    def _read(self, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read
            if schema is not None:
                reader = reader.schema(schema)
            return reader.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def events(self) -> DataFrame:
        df = self._read(self.events_dir, EVENT_SCHEMA)
        return df if df is not None else self.spark.createDataFrame([], EVENT_SCHEMA)

    def current(self) -> DataFrame:
        """Latest event per target; only targets whose latest event is a write."""
        latest = self.events().groupBy("target_id").agg(
            F.max_by(F.struct(*[c for c in EVENT_SCHEMA.fieldNames() if c != "target_id"]), "seq").alias("e")
        )
        return latest.select("target_id", "e.*").where(F.col("event") == EVENT_WRITE).drop("event", "seq")

    def entries(self, target_ids: DataFrame | None = None) -> DataFrame | None:
        """Stored index rows of the current snapshots (optionally of some targets)."""
        df = self._read(self.entries_dir, ENTRY_SCHEMA)
        if df is None:
            return None
        cur = self.current().select("target_id", "fingerprint")
        df = df.join(cur, ["target_id", "fingerprint"], "left_semi")
        if target_ids is not None:
            df = df.join(target_ids.select("target_id").distinct(), "target_id", "left_semi")
        return df

    def symbols(self, target_ids: DataFrame | None = None) -> DataFrame:
        """Current index rows with a symbol (stat-only rows left out)."""
        ent = self.entries(target_ids)
        if ent is None:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return ent.where(F.col("kind").isNotNull())

    def tombstones(self) -> DataFrame:
        """Latest streamed delete per file."""
        df = self._read(self.tombstones_dir, TOMBSTONE_SCHEMA)
        if df is None:
            df = self.spark.createDataFrame([], TOMBSTONE_SCHEMA)
        return df.groupBy("target_dir", "path").agg(F.max("deleted_ms").alias("deleted_ms"))

    # -- writes --------------------------------------------------------------
    def append_events(self, rows: DataFrame) -> None:
        """Append one event per target, each after the target's last one."""
        last = self.events().groupBy("target_id").agg(F.max("seq").alias("last_seq"))
        rows = rows.join(last, "target_id", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + 1)
        rows.select(*EVENT_SCHEMA.fieldNames()).write.mode("append").parquet(self.events_dir)

    def write_entries(self, entries: DataFrame) -> None:
        """Write the ``(target_id, fingerprint)`` partitions in ``entries``.

        Readers see them once their event is appended. A repeated write of the
        same fingerprint (a retried batch) replaces the partition with equal rows."""
        (
            # Spread by file, not by target: a target holding a third of all
            # rows is written by many tasks (a few files per partition each).
            entries.repartition("target_id", "path")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("target_id", "fingerprint")
            .parquet(self.entries_dir)
        )

    def append_tombstones(self, deletes: DataFrame) -> None:
        """Record streamed deletes (``target_dir, path, deleted_ms``)."""
        deletes.select("target_dir", "path", "deleted_ms").write.mode("append").parquet(self.tombstones_dir)

    def invalidate(self, targets: DataFrame, as_of: Column) -> None:
        """Mark targets' snapshots as gone (``targets``: ``target_dir``)."""
        self.append_events(
            targets.select(
                target_id("target_dir").alias("target_id"), "target_dir",
                F.lit(INDEX_VERSION).alias("version"), F.lit(None).cast("string").alias("fingerprint"),
                F.lit(EVENT_INVALIDATE).alias("event"), as_of.cast("timestamp").alias("generated_at"),
                F.lit(None).cast("long").alias("n_files"), F.lit(None).cast("array<decimal(38,0)>").alias("lanes"),
            )
        )

    def stats(self, targets: DataFrame) -> DataFrame:
        """Per asked target: whether a snapshot exists, its fingerprint and
        the number of stored files."""
        cur = self.current()
        ent = self.entries()
        asked = targets.select("target_dir").distinct().withColumn("target_id", target_id("target_dir"))
        if ent is not None:
            files = ent.groupBy("target_id").agg(F.countDistinct("path").alias("stored_files"))
            cur = cur.join(files, "target_id", "left")
        else:
            cur = cur.withColumn("stored_files", F.lit(None).cast("bigint"))
        return asked.join(cur.drop("target_dir"), "target_id", "left").select(
            "target_dir", "target_id", F.col("fingerprint").isNotNull().alias("exists"),
            "fingerprint", F.coalesce("stored_files", F.lit(0)).cast("bigint").alias("stored_files"),
        )

    # -- refresh ---------------------------------------------------------------
    def refresh(self, files: DataFrame, extract, as_of: Column, force: bool = False, targets: DataFrame | None = None) -> DataFrame:
        """Bring the snapshots of every target in ``files`` up to date.

        ``targets`` (``target_dir``) names targets to bring up to date whether
        or not they still have files: one without any loses its snapshot.

        ``extract(files) -> symbols`` is the extraction job. A target whose
        fingerprint matches its stored one is a hit and is not touched; for the
        others only added or changed files are extracted, unchanged files keep
        their stored rows, removed files drop out. Returns one status row per
        target: ``hit, layer, fingerprint, files_indexed, files_extracted,
        files_reused, files_removed``. ``force`` rebuilds every target.
        """
        manifest = file_manifest(files)
        fps = lane_sums(manifest).withColumn("target_id", target_id("target_dir"))
        cur = self.current().select("target_id", F.col("fingerprint").alias("stored_fp"), F.col("version").alias("stored_version"))
        if targets is not None:
            asked = targets.select("target_dir").distinct().withColumn("target_id", target_id("target_dir"))
            fps = fps.join(asked, ["target_id", "target_dir"], "full")
        st = fps.join(cur, "target_id", "left")
        hit = F.coalesce(
            F.lit(not force) & (F.col("stored_fp") == F.col("fingerprint")) & (F.col("stored_version") == INDEX_VERSION),
            F.lit(False),
        )
        # Materialise the decision before the store is written: a plan that
        # reads the store would otherwise be re-run against the new files.
        st = materialize(st.withColumn("hit", hit), "refresh-status")
        changed = st.where(~F.col("hit"))
        miss = changed.where(F.col("fingerprint").isNotNull()).select("target_id", "target_dir", "fingerprint", "n_files", "lanes")
        emptied = changed.where(F.col("fingerprint").isNull() & F.col("stored_fp").isNotNull())
        if changed.isEmpty():
            return self._refresh_status(st, self.spark.createDataFrame([], "target_dir string, path string, status string"))

        stored = self.entries(changed)
        old = stored
        if force:
            # Everything is extracted anew; only targets left without files have an old side.
            old = stored.join(emptied.select("target_id"), "target_id", "left_semi") if stored is not None else None
        new_man = manifest.join(miss.select("target_dir"), "target_dir", "left_semi")
        if old is not None:
            old_man = old.select("target_dir", "path", *ENTRY_STAT_COLUMNS).distinct()
            changes = diff(old_man, new_man)
        else:
            changes = new_man.select("target_dir", "path", F.lit("added").alias("status"))
        changes = materialize(changes, "refresh-changes")
        todo = changes.where(F.col("status").isin("added", "changed")).select("target_dir", "path")
        to_extract = files.join(todo, ["target_dir", "path"], "left_semi")
        # Every file keeps a stat row (symbol columns NULL when it exports
        # nothing), so an unchanged file is never extracted again.
        fresh = new_man.join(todo, ["target_dir", "path"], "left_semi").join(
            extract(to_extract), ["target_dir", "path"], "left"
        )
        parts = [fresh.select(*SYMBOL_COLUMNS, *ENTRY_STAT_COLUMNS)]
        if stored is not None and not force:
            keep = changes.where(F.col("status") == "unchanged").select("target_dir", "path")
            parts.append(stored.join(keep, ["target_dir", "path"], "left_semi").select(*SYMBOL_COLUMNS, *ENTRY_STAT_COLUMNS))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self.write_entries(rows.join(miss.select("target_id", "target_dir", "fingerprint"), "target_dir"))
        self.append_events(
            miss.select(
                "target_id", "target_dir", F.lit(INDEX_VERSION).alias("version"), "fingerprint",
                F.lit(EVENT_WRITE).alias("event"), as_of.cast("timestamp").alias("generated_at"), "n_files", "lanes",
            )
        )
        self.invalidate(emptied.select("target_dir"), as_of)
        return self._refresh_status(st, changes)

    def _refresh_status(self, st: DataFrame, changes: DataFrame) -> DataFrame:
        """One written status row per target, after the store is up to date."""
        counts = changes.groupBy("target_dir").agg(
            F.count_if(F.col("status").isin("added", "changed")).alias("files_extracted"),
            F.count_if(F.col("status") == "unchanged").alias("files_reused"),
            F.count_if(F.col("status") == "removed").alias("files_removed"),
        )
        indexed = self.symbols(st).groupBy("target_id").agg(F.countDistinct("path").alias("files_indexed"))
        out = st.join(counts, "target_dir", "left").join(indexed, "target_id", "left").select(
            "target_dir", "target_id", "hit",
            F.when(F.col("hit"), F.lit("disk")).otherwise(F.lit("rebuild")).alias("layer"),
            "fingerprint",
            F.coalesce("files_indexed", F.lit(0)).cast("bigint").alias("files_indexed"),
            F.coalesce("files_extracted", F.lit(0)).cast("bigint").alias("files_extracted"),
            F.coalesce("files_reused", F.lit(0)).cast("bigint").alias("files_reused"),
            F.coalesce("files_removed", F.lit(0)).cast("bigint").alias("files_removed"),
        )
        # Written, not left as a plan: a later refresh must not change this answer.
        return materialize(out, "refresh-result")


# ---------------------------------------------------------------------------
# Retention and freshness (the reference's LRU capacity and TTL, as queries)
# ---------------------------------------------------------------------------

def retention(accesses: DataFrame, group_col: str, key_col: str, ts_col: str, keep: int = MEMORY_MAX_ENTRIES) -> DataFrame:
    """Per group, the ``keep`` most recently accessed keys (ties: smaller key).

    Accesses are first reduced to one row per (group, key) with a map-side
    partial max; the ranking filter plans a per-partition group limit before
    its shuffle, so a hot group never sends more than ``keep`` rows per
    partition."""
    last = accesses.groupBy(group_col, key_col).agg(F.max(ts_col).alias("last_access_at"))
    w = Window.partitionBy(group_col).orderBy(F.col("last_access_at").desc(), F.col(key_col).asc())
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def freshness(sets: DataFrame, set_col: str, as_of: Column, ttl_seconds: int = MEMORY_TTL_SECONDS) -> DataFrame:
    """Adds ``expires_at`` = set time + ttl and ``fresh`` = as_of <= expires_at.
    Access does not extend the lifetime (set time only)."""
    exp = F.col(set_col) + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return sets.withColumn("expires_at", exp).withColumn("fresh", as_of <= F.col("expires_at"))


def match_snapshots(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Hit test of the reference: a stored snapshot is reused only when
    version, target dir and fingerprint all equal the current ones.
    ``current``: ``(target_dir, fingerprint)``; ``stored``: ``(target_dir,
    version, fingerprint)``."""
    cur = current.withColumn("target_id", target_id("target_dir"))
    st = stored.select(
        target_id("target_dir").alias("target_id"), F.col("target_dir").alias("s_dir"),
        F.col("version").alias("s_version"), F.col("fingerprint").alias("s_fp"),
    )
    j = cur.join(st, "target_id", "left")
    hit = F.coalesce(
        (F.col("s_version") == INDEX_VERSION) & (F.col("s_dir") == F.col("target_dir")) & (F.col("s_fp") == F.col("fingerprint")),
        F.lit(False),
    )
    return j.select(
        "target_dir", "target_id", "fingerprint", hit.alias("hit"),
        F.when(hit, F.lit("disk")).otherwise(F.lit("rebuild")).alias("layer"),
    )
