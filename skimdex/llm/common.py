"""Shared pieces of the training-data operators: text rules and staging."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.session import scratch_path
from skimdex.sources.tables import table

# The white space of all contracts: [\x20\x09-\x0D].
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The named columns of `documents`; others never reach the plan."""
    return table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text")))


def nonnull(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only (lower() would change other letters as well)."""
    return F.translate(col, UPPER, LOWER)


def strip_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def delete_ws(col: Column) -> Column:
    return F.translate(col, WS_CHARS, "")


def text_key(col: Column | str = "text") -> Column:
    """64 bits of the text: tells rows of one doc_id apart."""
    return F.xxhash64(nonnull(col))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same value; as a pair 128 bits."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, arrow_rows: int = 2_000, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and
    survives lost executors. The write is one execution of its own, so Spark may
    delete its shuffle files at the end. ``arrow_rows`` bounds the batches that
    Python functions get, for texts or blobs of any length."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, {CLEANUP: "true", ARROW_ROWS: str(arrow_rows)}):
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, n_rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the counted size is within ``limit``; otherwise the
    plain frame, for which Spark plans a shuffled join."""
    return F.broadcast(df) if n_rows * row_bytes <= limit else df


def lookup(df: DataFrame, row_bytes: int, name: str = "lookup") -> DataFrame:
    """``df`` written once, counted, and broadcast if it is small enough; texts then
    stay where they are. Beyond the limit Spark shuffles both sides."""
    kept = stage(df, name)
    return bounded_broadcast(kept, kept.count(), row_bytes)


def ship(module: str) -> None:
    """Functions of ``module`` travel to the workers whole: an executor need not
    have this package installed."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])
