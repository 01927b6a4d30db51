"""Ranked lexical search: accumulator-limited term-at-a-time over range-sorted postings.

The query set is stated (each item of a table is a query); all documents are ranked.

* One pass over the texts counts the terms of each document, and keeps as postings
  (term, document, occurrences, document length) what the query set asks for; its
  vocabulary is broadcast behind a size check. Postings are written to the shared folder
  in the order of their terms' document frequency, rarest first, so a round reads only
  the row groups of its terms.
* Rounds go through each item's terms rarest first, one more, then two, four, eight: a
  round adds its terms' exact scores to the item's accumulators (item, document). After
  each round the kth best partial score of an item is compared with the sum of the upper
  bounds of its remaining terms (a term's weight times the highest impact among its
  postings). Once the bounds are below it, a document without an accumulator cannot
  reach the first k, not even by a tie, and the item creates no more.
* Survivors are then updated exactly: accumulators of stopped items are joined to the
  remaining postings of their terms by (document, term), and the first k of each item
  are taken from them.

Scores are sums of integers, so order of addition does not matter. Sums are combined on
the map side, a hot term's postings lie in many ranges and are split by the join, and
the first k of an item are limited within partitions before any shuffle. Nothing is
sampled or capped; each round is written to the shared folder.

Defined cases: a null or empty text has no terms and is no document of the statistics. A
null item has no terms and gives no rows. Rows that share a doc_id, and repeated rows,
are documents of their own; so are rows that share an item_id queries of their own.
Equal scores go by ascending doc_id, null last. Very long texts are split into terms
within one row; terms are counted outside it. Empty tables give no rows. Other columns
than (doc_id, text) and (item_id, text) are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.llm.common import LOWER, UPPER, ascii_lower, bounded_broadcast, lookup, nonnull, partitions, stage

#: What parts terms: ASCII other than digits and letters.
GAP_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Fixed values of the score.
LENGTH_SHARE, IMPACT, TF_SHARE, NORM = 75, 1_000_000_000, 1000, 8


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.filter(F.split(ascii_lower(nonnull(text)), GAP_RE), lambda t: t != "")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def query_terms(items: DataFrame) -> DataFrame:
    """(iid, item_id, term, repeats) of each distinct term of an item; iid tells rows of
    one item_id apart."""
    rows = stage(items.select(F.monotonically_increasing_id().alias("iid"), "item_id", terms(F.col("text")).alias("terms")), "items")
    return stage(rows.select("iid", "item_id", F.explode("terms").alias("term")).groupBy("iid", "item_id", "term").agg(F.count("*").alias("repeats")), "query")


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tid, uid, doc_id, n, tf) of each document and term of ``vocabulary`` (term, tid) it
    holds; uid tells rows apart, n is the document's number of terms. Each document also
    has a row of tid -1, so one pass gives the statistics too."""
    known = vocabulary.union(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid")))
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), terms(F.col("text")).alias("terms"))
    d = d.select("uid", "doc_id", F.size("terms").cast("long").alias("n"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    held = d.join(lookup(known, 64, "vocabulary"), "term")
    return stage(held.groupBy("tid", "uid", "doc_id", "n").agg(F.count("*").alias("tf")), "counts")


def _impact(n_docs: int, n_terms: int) -> Column:
    """What an occurrence count is worth in a document of its length, a 64-bit integer."""
    n, docs, all_terms = F.col("n"), F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long")
    wide = lambda c: c.cast("decimal(19,0)")
    fits = n <= (2**63 - 1) // (LENGTH_SHARE * max(n_docs, 1))
    relative = F.when(fits, _div(LENGTH_SHARE * n * docs, all_terms)).otherwise(_div(wide(LENGTH_SHARE * n) * wide(docs), wide(all_terms)).cast("long"))
    return _div(F.lit(IMPACT).cast("long") * F.col("tf"), TF_SHARE * F.col("tf") + NORM * (100 - LENGTH_SHARE + relative))


def _weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * df + 1))).cast("long")


def postings(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (df, tid, uid, doc_id, impact) written in the order of df, and for each
    term (tid, df, weight, highest): its weight and the highest impact it has."""
    total = counts.filter("tid = -1").agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 1
    scored = counts.filter("tid >= 0").select("tid", "uid", "doc_id", _impact(n_docs, n_terms).alias("impact"))
    known = scored.groupBy("tid").agg(F.count("*").alias("df"), F.max("impact").alias("highest"))
    known = stage(known.select("tid", "df", "highest", _weight(n_docs, F.col("df")).alias("weight")), "terms")
    rows = scored.join(bounded_broadcast(known.select("tid", "df"), known.count(), 24), "tid")
    rows = rows.repartitionByRange(partitions(counts.sparkSession), "df", "tid", "uid").sortWithinPartitions("df", "tid")
    return stage(rows.select("df", "tid", "uid", "doc_id", "impact"), "postings"), known


def plan_items(query: DataFrame, known: DataFrame) -> DataFrame:
    """(iid, item_id, pos, tid, df, weight, rest) of each item's terms, rarest first:
    weight with repeats, and the bound of what the later terms can add."""
    bound = F.col("weight") * F.col("highest")
    w = Window.partitionBy("iid").orderBy("df", "tid")
    q = query.join(known, "tid").filter("weight > 0").withColumn("weight", F.col("weight") * F.col("repeats"))
    later = F.coalesce(F.sum(bound).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return stage(q.select("iid", "item_id", F.row_number().over(w).alias("pos"), "tid", "df", "weight", later.alias("rest")), "plan")


ITEM = ["iid", "uid", "doc_id"]


def _gains(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """(iid, uid, doc_id, score) of the postings of ``asked`` terms (iid, tid, df, weight)."""
    low, high = asked.agg(F.min("df"), F.max("df")).first()
    mine = posted.filter(F.col("df").between(low or 0, high or 0)).drop("df")
    return mine.join(lookup(asked.select("iid", "tid", "weight"), 32), "tid").select(*ITEM, (F.col("weight") * F.col("impact")).alias("score"))


def _stopped(acc: DataFrame, asked: DataFrame, last: int) -> DataFrame:
    """(iid, at, kth, rest) of items that create no more accumulators after position
    ``last``: none of their other documents can reach the kth best, or no term is left."""
    w = Window.partitionBy("iid").orderBy(F.desc("score"))
    kth = acc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP).groupBy("iid").agg(
        F.max(F.when(F.col("rank") == TOP, F.col("score"))).alias("kth")
    )
    ends = asked.filter(F.col("pos") <= last).groupBy("iid").agg(F.max_by("rest", "pos").alias("rest"), F.max("pos").alias("at"))
    longest = asked.groupBy("iid").agg(F.max("pos").alias("terms"))
    out = ends.join(longest, "iid").join(kth, "iid", "left").select("iid", "at", "terms", "rest", F.coalesce("kth", F.lit(0).cast("long")).alias("kth"))
    return out.filter("rest < kth or at = terms").drop("terms")


def survivors(posted: DataFrame, planned: DataFrame, trace: list | None = None) -> DataFrame:
    """(iid, uid, doc_id, score, at): for each item every document that can be among its
    first k, with its exact score over the first ``at`` terms. ``trace`` takes, for each
    round, (last position, items that stopped, items left)."""
    active, acc, done, low, step = planned, None, [], 0, 1
    while (left := active.select("iid").distinct().count()) or acc is None:
        high = low + step
        chunk = stage(active.filter((F.col("pos") > low) & (F.col("pos") <= high)), "chunk")
        gained = _gains(posted, chunk)
        both = gained if acc is None else acc.unionByName(gained)
        acc = stage(both.groupBy(*ITEM).agg(F.sum("score").alias("score")), "accumulators")
        stop = stage(_stopped(acc, active, high), "stopped")
        n = stop.count()
        small = bounded_broadcast(stop, n, 32)
        # An accumulator that its bounds keep below the kth partial score is settled.
        done.append(acc.join(small, "iid").filter("score + rest >= kth").select(*ITEM, "score", "at"))
        if trace is not None:
            trace.append((high, n, left - n))
        ended = bounded_broadcast(stop.select("iid"), n, 8)
        acc, active = acc.join(ended, "iid", "left_anti"), active.join(ended, "iid", "left_anti")
        low, step = high, 2 * step
        if n == left:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stage(out, "survivors")


def search(docs: DataFrame, items: DataFrame, trace: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` best documents of each item of ``items``
    (item_id, text) among all of ``docs`` (doc_id, text) whose score is above 0."""
    query = query_terms(items)
    vocabulary = stage(query.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    query = query.join(vocabulary, "term").drop("term")
    posted, known = postings(term_counts(docs, vocabulary))
    planned = plan_items(query, known)
    found = survivors(posted, planned, trace)

    open_terms = planned.select("iid", "pos", "tid", "weight")
    asked = found.join(open_terms, "iid").filter("pos > at").select("iid", "uid", "tid", "weight")
    rest = lookup(asked, 40, "open")  # (term, document) pairs, broadcast if they are few
    gained = posted.select("tid", "uid", "doc_id", "impact").join(rest, ["tid", "uid"]).select(*ITEM, (F.col("weight") * F.col("impact")).alias("score"))
    scores = found.select(*ITEM, "score").unionByName(gained).groupBy(*ITEM).agg(F.sum("score").alias("score")).filter("score > 0")
    best = Window.partitionBy("iid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP)
    names = planned.select("iid", "item_id").distinct()
    return ranked.join(names, "iid").select("item_id", "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, sum(len(ts))::BIGINT AS ll FROM d),
q AS (SELECT iid, item_id, term, count(*) AS repeats
      FROM (SELECT iid, item_id, unnest(ts) AS term
            FROM (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS ts FROM benchmark)) GROUP BY ALL),
p AS (SELECT uid, doc_id, n, term, count(*) AS tf
      FROM (SELECT uid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT iid, item_id, uid, doc_id,
             sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::BIGINT AS score
      FROM p JOIN t USING (term) JOIN q USING (term), s GROUP BY iid, item_id, uid, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM x WHERE score > 0)
WHERE rank <= 10
"""
