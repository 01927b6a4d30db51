"""Packing into optimal length buckets.

One histogram of text lengths over all documents goes to the driver, where dynamic
programming (least cost by lower envelopes of lines) chooses the `N_BUCKETS`
boundaries that minimise padding. Documents are then packed inside their bucket:
a batch takes as many as fit the token budget when each is padded to the boundary.

The histogram has a bin for each length there is, so the boundaries are the optimum
at any size. It is bounded: `k` different lengths sum to k^2 / 2 at least, so 100 TB of
text (some 1.6e13 words) have 5.7 million bins of 16 bytes at worst. Documents are
numbered inside shards of about `SHARD_DOCS` of a bucket, whose number the histogram
gives; a bucket that holds most documents is many shards, and each shard leaves one
batch unfilled at most.

Defined cases: the length is the number of words, or the given column; null or empty
texts have length 0 and go to the first bucket; a document longer than the budget is
a batch of its own, uncut; repeated rows are packed each; equal lengths share a
bucket; no rows in, no rows out; other columns are ignored.
"""

from __future__ import annotations

import bisect
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.llm.common import stage
from skimdex.llm.mixing import size_of

N_BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_DOCS = 200_000


def best_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper ends of at most ``n_buckets`` buckets with the least sum of boundary
    x documents. With C the running count, closing a bucket at j after i costs
    best[i] + lengths[j] * (C[j] - C[i]): for each j the lowest of lines with
    slope -C[i], which falls as i grows, so the lower envelope is a stack."""
    n = len(lengths)
    if not n:
        return []
    run = [0]
    for c in counts:
        run.append(run[-1] + c)
    best = [0] + [lengths[j] * run[j + 1] for j in range(n)]
    cuts = [array("q", bytes(8 * (n + 1)))]
    for _ in range(1, min(n_buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, offset, i
        at, new, cut = 0, [0] * (n + 1), array("q", bytes(8 * (n + 1)))
        for j in range(n):
            slope, offset = -run[j], best[j]
            while len(lines) >= 2:
                (s1, o1, _), (s2, o2, _) = lines[-2], lines[-1]
                if (offset - o1) * (s1 - s2) <= (o2 - o1) * (s1 - slope):
                    lines.pop()
                else:
                    break
            lines.append((slope, offset, j))
            at = min(at, len(lines) - 1)
            x = lengths[j]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] <= lines[at][0] * x + lines[at][1]:
                at += 1
            s, o, i = lines[at]
            new[j + 1], cut[j + 1] = s * x + o + x * run[j + 1], i
        best = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(lengths[j - 1])
        j = cut[j]
    return ends[::-1]


def pack(docs: DataFrame, length: Column | None = None, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, shard, batch (unique for bucket and
    shard), slot, padding of every row."""
    n = F.coalesce(length if length is not None else size_of(F.col("text")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", n.alias("n_tokens"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    hist = rows.groupBy(F.col("n_tokens").alias("n")).agg(F.count(F.lit(1)).alias("k")).toPandas()
    hist = sorted(zip(hist["n"].tolist(), hist["k"].tolist()))
    ends = best_boundaries([x for x, _ in hist], [k for _, k in hist], n_buckets)
    if not ends:
        ends = [0]
    held = [0] * len(ends)
    for x, k in hist:
        held[bisect.bisect_left(ends, x)] += k
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    fits = [max(1, budget // max(1, e)) for e in ends]
    shards = [-(-k // shard_docs) or 1 for k in held]
    # Rows without a doc_id are dealt by the row's number in the staged table.
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    order = Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "n_tokens")
    return (
        rows.withColumn("bucket", bucket)
        .withColumns({"boundary": pick(ends), "h": h, "shard": F.pmod(h, pick(shards)).cast("int")})
        .withColumn("at", F.row_number().over(order) - 1)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "boundary",
            "shard",
            F.floor(F.col("at") / pick(fits)).alias("batch"),
            F.pmod(F.col("at"), pick(fits)).cast("int").alias("slot"),
            (F.col("boundary") - F.col("n_tokens")).alias("padding"),
        )
    )
