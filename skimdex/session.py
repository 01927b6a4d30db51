"""Session construction and shared-storage helpers.

On a cluster the session is handed to us; we only read its settings. The
local builder below is for tests and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package assumes. AQE re-plans joins at run time
# (broadcast only when the measured side is under the threshold, split skewed
# partitions of a join, coalesce small shuffle partitions).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "skimdex") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Pin the SQL settings our results depend on (time zone) and the AQE knobs."""
    for k, v in SESSION_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``. Only a local session, whose
    executors share the driver's disk, may do without: it gets a private folder.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            root = None
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skimdex-shared-")
    root = root.rstrip("/")
    if not (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:").startswith(root.removeprefix("file:")):
        spark.sparkContext.setCheckpointDir(root)
    return root


_SCOPE = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end the folders that this thread writes inside it, through the
    file system that holds them. Yields their list; one taken off the list stays, for
    instance that of a result. Results still to be computed must not leave the block."""
    outer, made = getattr(_SCOPE, "made", None), []
    _SCOPE.made = made
    try:
        yield made
    finally:
        _SCOPE.made = outer
        context = spark.sparkContext
        for path in made:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    base = shared_dir(spark)
    if "://" not in base:
        os.makedirs(base, exist_ok=True)
    path = f"{base}/skimdex-{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_SCOPE, "made", None) is not None:
        _SCOPE.made.append(path)
    return path


def dealt(df, *keys: str):
    """``df`` over the session's shuffle partitions, by ``keys``: few files or row groups
    would else be few tasks, whatever is computed from a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the input only once
    (an eager checkpoint runs it for the count and again for the write), and
    later reads prune columns. The folder survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
