"""Line dedup: range-partitioned line hashes, keep bitmaps per document.

Every line becomes a row (hash, document, position). The rows are
range-partitioned by hash and a salt of the document, so that a line found in a
third of all documents spreads over neighbouring partitions, and sorted by
document and position inside. A window streams over each run and marks the
first occurrence per document; a second, map-side combined aggregate joins the
salts of a key. Lines of frequent keys turn into one compressed bitmap per
document; the text itself is read once, when a bitmap is applied.

Defined cases: null text is empty, an empty text is one empty line; lines whose
key is shorter than one code point are always kept; rows that share doc_id (null
as well) count as one document when documents are counted, and each row is
answered by its own text; repeated rows give repeated, equal answers; other
columns of the input are ignored. No rows in, no rows out. A text of any length is
one row in and out and has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skimdex.llm.common import ascii_lower, bounded_broadcast, hash128, nonnull, partitions, stage, strip_ws, text_key

MIN_DOCS = 10


def split_lines(col):
    return F.split(col, "\n", -1)


def line_occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, salt, doc_id, tk, pos) of every line with a key."""
    n = partitions(docs.sparkSession)
    keys = F.transform(split_lines(nonnull("text")), lambda x: ascii_lower(strip_ws(x)))
    h1, h2 = hash128(F.col("key"))
    return (
        docs.select("doc_id", text_key().alias("tk"), F.posexplode(keys).alias("pos", "key"))
        .filter(F.length("key") >= 1)
        .select(h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("salt"), "doc_id", "tk", "pos")
    )


def first_occurrences(occ: DataFrame) -> DataFrame:
    """Adds `first_in_doc`: no earlier row of this document has the key."""
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos", "tk")
    doc = F.struct("doc_id")
    return occ.repartitionByRange("h1", "h2", "salt").withColumn("first_in_doc", ~F.lag(doc).over(run).eqNullSafe(doc))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, tk, drop_words): per document the 64-line words in which lines
    go, as (word, bits); words without a dropped line are not stored. With
    ``keep_first`` the first occurrence in (doc_id, position) order stays."""
    occ = stage(first_occurrences(line_occurrences(docs)), "lines")
    # Written, so that the join deals both sides itself and Spark can split a hot key.
    frequent = stage(
        occ.groupBy("h1", "h2")
        .agg(F.sum(F.col("first_in_doc").cast("long")).alias("n_docs"), F.min(F.struct("doc_id", "pos")).alias("first"))
        .filter(F.col("n_docs") >= min_docs),
        "frequent",
    )
    gone = occ.join(frequent, ["h1", "h2"])
    if keep_first:
        gone = gone.filter(~F.col("first").eqNullSafe(F.struct("doc_id", "pos")))
    bit = F.expr("shiftleft(1L, pos & 63)")
    return (
        gone.select("doc_id", "tk", "pos")
        .repartition("doc_id", "tk")
        .groupBy("doc_id", "tk", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc_id", "tk")
        .agg(F.collect_list(F.struct("word", "bits")).alias("drop_words"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of ``docs``."""
    d = docs.select("doc_id", nonnull("text").alias("text"), text_key().alias("tk")).alias("d")
    stored = stage(bitmaps, "bitmaps")
    size = stored.select(F.sum(F.size("drop_words") * 16 + 64)).first()[0] or 0
    b = bounded_broadcast(stored, 1, size).alias("b")
    dropped = F.flatten(
        F.transform(
            "drop_words",
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w["bits"], i) == 1),
                lambda i: w["word"] * 64 + i,
            ),
        )
    )
    n_lines = F.col("n_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n_lines.cast("int") - 1), dropped), lambda p: F.get(F.col("lines"), p))
    return (
        d.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.tk") == F.col("b.tk")), "left")
        .select(F.col("d.doc_id").alias("doc_id"), "text", "drop_words", split_lines(F.col("text")).alias("lines"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .select(
            "doc_id",
            "n_lines",
            F.when(F.col("drop_words").isNull(), F.lit(0)).otherwise(F.size(dropped)).cast("long").alias("n_dropped"),
            F.when(F.col("drop_words").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        )
    )


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, keep_first))


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
