"""Exact dedup by a sharded cuckoo-filter index of live digests.

A text's key is the SHA-256 of the text without white space. Keys are dealt to
shards by their first bits. Each shard has a cuckoo filter (16-bit fingerprints,
four to a bucket) and, beside it, the stored keys. The filter decides: a lookup that
misses it is new for certain and no stored key is looked at; a hit is checked against
the stored keys, so false positives cost a comparison and change nothing. Insertion
that finds no free place doubles the filter and fills it from the stored keys; deletion
takes the fingerprint of a live key out. Where the row that represents a key is deleted
and other copies live, the best of those represents it from then on.

Copies are combined before they are dealt: rows are grouped by key and a salt of
their document, so one key reaches its shard as `SALTS` rows at most, whatever its
number of copies. Shards hold about `SHARD_KEYS` keys, and their number follows the
input.

Defined cases: null text is empty, and empty texts are copies of each other; of
equal texts the row with the most code points, then the smallest doc_id (null last)
stays; rows that repeat a doc_id and a text are told apart by a row number, so one
row stays; no rows in, no rows out; a text of any length is one row and
has to fit a task; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import delete_ws, lookup, nonnull, ship, stage

ship(__name__)
SHARD_KEYS = 250_000
SALTS = 16
SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Fingerprints of 64-bit keys in 2^k buckets of four slots; 0 is free."""

    def __init__(self, log_buckets: int = 4, table: bytes | None = None):
        self.n = 1 << log_buckets
        shape = (self.n, SLOTS)
        self.slots = np.zeros(shape, np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(shape).copy()

    @classmethod
    def sized_for(cls, n_keys: int) -> CuckooFilter:
        return cls(max(4, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8))))))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        mark = ((mixed >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (mixed >> np.uint64(8)).astype(np.int64) & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, at, mark):
        return at ^ ((np.asarray(mark).astype(np.int64) * 0x5BD1E995) & (self.n - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place: the caller resizes from its keys."""
        mark, first, second = self._places(keys)
        left = np.arange(len(mark))
        for at in (first, second):
            for _ in range(SLOTS):  # a round places one key in each bucket
                free = left[(self.slots[at[left]] == 0).any(axis=1)]
                now = free[np.unique(at[free], return_index=True)[1]]
                self.slots[at[now], (self.slots[at[now]] == 0).argmax(axis=1)] = mark[now]
                left = np.setdiff1d(left, now, assume_unique=True)
        return all(self._kick(int(second[i]), int(mark[i])) for i in left)

    def _kick(self, at: int, mark: int) -> bool:
        for k in range(MAX_KICKS):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
            out = int(self.slots[at, k % SLOTS])
            self.slots[at, k % SLOTS] = mark
            mark, at = out, int(self._other(at, out))
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Keys must be live: a fingerprint that was never set isn't theirs."""
        for m, *places in zip(*self._places(keys)):
            for at in places:
                found = np.flatnonzero(self.slots[at] == m)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()


def filled(keys: np.ndarray, at_least: CuckooFilter | None = None) -> CuckooFilter:
    """A filter of the distinct ``keys``, doubled until every key has a place."""
    f = CuckooFilter.sized_for(len(keys))
    if at_least is not None and at_least.n > f.n:
        f = CuckooFilter(at_least.n.bit_length() - 1)
    while not f.insert(keys):
        f = CuckooFilter(f.n.bit_length())
    return f


INDEX = "shard int, digest string, doc_id long, n_cp long, row_no long, copies long, filter binary"
LOOKUP_BLOCK = 50_000


def _keys64(digests) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(d[:16] for d in digests)), ">u8").astype(np.uint64)


class _Shard:
    """One shard of the index in a task: the filter and the keys of its bucket."""

    def __init__(self, stored: pd.DataFrame):
        tables = stored.loc[stored["digest"].isna(), "filter"]
        live = stored[stored["digest"].notna()]
        self.rows = {r[0]: list(r[1:]) for r in live[["digest", "doc_id", "n_cp", "row_no", "copies"]].itertuples(index=False)}
        if len(tables):
            table = tables.iloc[0]
            self.filter = CuckooFilter((len(table) // (2 * SLOTS)).bit_length() - 1, table)
        else:
            self.filter = filled(_keys64(self.rows)) if self.rows else CuckooFilter()

    def _add(self, digests: list[str]) -> None:
        if digests and not self.filter.insert(_keys64(digests)):
            self.filter = filled(_keys64(self.rows), CuckooFilter(self.filter.n.bit_length()))

    @staticmethod
    def _rank(row: list) -> tuple:
        doc, n_cp, row_no, _ = row
        return (n_cp, not pd.isna(doc), 0 if pd.isna(doc) else -doc, -row_no)

    def _best(self, mine: list, row: list) -> list:
        return [*max(mine, row, key=self._rank)[:3], mine[3] + row[3]]

    def insert(self, rows: list[tuple]) -> None:
        for k in range(0, len(rows), LOOKUP_BLOCK):
            block: dict[str, list] = {}
            for digest, *row in rows[k : k + LOOKUP_BLOCK]:  # the keys of a block are distinct
                mine = block.get(digest)
                block[digest] = row if mine is None else self._best(mine, row)
            hits = self.filter.contains(_keys64(block)) if block else ()
            fresh = []
            for (digest, row), hit in zip(block.items(), hits):
                if hit and digest in self.rows:  # checked against the stored keys
                    self.rows[digest] = self._best(self.rows[digest], row)
                else:
                    fresh.append((digest, row))
            self.rows.update(fresh)
            self._add([digest for digest, _ in fresh])

    def represent(self, rows: list[tuple]) -> None:
        """Other representatives of live keys."""
        for digest, *row in rows:
            self.rows[digest][:3] = row[:3]

    def delete(self, rows: list[tuple]) -> None:
        for r in rows:
            if not self.filter.contains(_keys64([r[0]]))[0] or r[0] not in self.rows:
                continue
            self.rows[r[0]][3] += r[4]
            if self.rows[r[0]][3] <= 0:
                del self.rows[r[0]]
                self.filter.delete(_keys64([r[0]]))

    def frame(self, shard: int) -> pd.DataFrame:
        out = [(shard, d, *r, None) for d, r in self.rows.items()]
        out.append((shard, None, None, None, None, None, self.filter.to_bytes()))
        frame = pd.DataFrame(out, columns=["shard", "digest", "doc_id", "n_cp", "row_no", "copies", "filter"])
        return frame.astype({c: "Int64" for c in ("doc_id", "n_cp", "row_no", "copies")})


def _change(key: tuple, stored: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    shard = _Shard(stored)
    rows = list(changes[["digest", "doc_id", "n_cp", "row_no", "copies"]].itertuples(index=False, name=None))
    shard.insert([r for r in rows if r[4] > 0])
    shard.delete([r for r in rows if r[4] < 0])
    shard.represent([r for r in rows if r[4] == 0])
    return shard.frame(int(key[0]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_cp (code points of the text) and a row number."""
    text = nonnull("text")
    return docs.select(
        "doc_id",
        F.sha2(delete_ws(text), 256).alias("digest"),
        F.length(text).cast("long").alias("n_cp"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _shard(n_shards: int):
    return F.pmod(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


def _combined(d: DataFrame) -> DataFrame:
    """Copies of a key as one row for each salt: its best row and their number."""
    best = F.max(F.struct(F.col("n_cp"), (-F.col("doc_id")).alias("doc"), (-F.col("row_no")).alias("row")))
    salt = F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).alias("salt")
    return (
        d.groupBy("digest", salt)
        .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
        .select("digest", (-F.col("best.doc")).alias("doc_id"), F.col("best.n_cp").alias("n_cp"), (-F.col("best.row")).alias("row_no"), "copies")
    )


def _changed(index: DataFrame, changes: DataFrame, n_shards: int) -> DataFrame:
    new = changes.withColumn("shard", _shard(n_shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_change, INDEX)


def insert(index: DataFrame, d: DataFrame, n_shards: int) -> DataFrame:
    """The index with the rows of ``d`` (see ``digests``) made live."""
    return _changed(index, _combined(d), n_shards)


def delete(index: DataFrame, d: DataFrame, live: DataFrame, n_shards: int) -> DataFrame:
    """The index without the rows of ``d``; a key goes with its last copy. ``live`` are
    the rows (see ``digests``) that stay: keys whose representative goes take the best of
    theirs."""
    less = _combined(d).withColumn("copies", -F.col("copies"))
    left = stage(_changed(index, less, n_shards), "index")
    lost = keys(left).join(d.select("digest", "row_no"), ["digest", "row_no"], "left_semi").select("digest")
    best = F.max(F.struct("n_cp", (-F.col("doc_id")).alias("doc"), (-F.col("row_no")).alias("row"))).alias("best")
    other = _combined(live.join(lost, "digest", "left_semi")).groupBy("digest").agg(best)
    again = other.select("digest", (-F.col("best.doc")).alias("doc_id"), F.col("best.n_cp").alias("n_cp"), (-F.col("best.row")).alias("row_no"), F.lit(0).cast("long").alias("copies"))
    return _changed(left, again, n_shards)


def keys(index: DataFrame) -> DataFrame:
    return index.filter(F.col("digest").isNotNull()).drop("filter")


def shards_for(n_rows: int, least: int) -> int:
    return max(least, -(-n_rows // SHARD_KEYS))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, n_cp, row_no."""
    spark = docs.sparkSession
    d = stage(digests(docs.select("doc_id", "text")), "digests")
    n_shards = shards_for(d.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    live = keys(insert(empty_index(spark), d, n_shards)).select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), F.col("copies").alias("group_size")
    )
    return d.join(stage(live, "live"), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"), "n_cp", "row_no"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST)
"""


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each text. Rows that
    repeat the kept one in doc_id and length are one row."""
    keep = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("k_doc"), F.col("text_sha256").alias("k_digest"), F.col("n_cp").alias("k_cp"))
    text = nonnull("text")
    d = docs.withColumns({"digest": F.sha2(delete_ws(text), 256), "n_cp": F.length(text).cast("long")})
    same = (F.col("digest") == F.col("k_digest")) & (F.col("n_cp") == F.col("k_cp")) & F.col("doc_id").eqNullSafe(F.col("k_doc"))
    return d.join(lookup(keep, 128), same, "left_semi").dropDuplicates(["digest"]).select(*docs.columns)
