"""Document fingerprints: one-permutation MinHash with optimal densification and packed
low-order bits, in DataFrame functions only.

* A text's set is its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
  lower-cased); with fewer words the whole sequence is one shingle. Each shingle is
  hashed once to 63 bits: the upper 8 are its bin, of 256, and each bin keeps its least
  hash. One sort does it: the hashes and one mark per bin (the greatest value of the
  bin) are sorted, and the first of each bin stays, a mark where no hash fell.
* Optimal densification: an empty bin takes the value of the first occupied bin in its
  own fixed random order of bins (``a * t + b`` modulo 256 for t = 0, 1, ...), the same
  order for every document. The first ``PROBES`` are tried directly; beyond them the
  occupied bin with the least t is computed from the inverse of a.
* Of each bin the 4 low-order bits of a hash of (value, bin) are packed, 16 bins to a
  64-bit integer; the fingerprint is their hex text (256 digits). Hashing with the bin
  keeps chance agreement independent from bin to bin, also where one value fills many.
* Likeness of two fingerprints: the share p of equal bins, found by exclusive-or and
  bit_count, corrected for agreement by chance, ``(p - 1/16) / (1 - 1/16)``, not below 0.
  Its standard error is at most 0.033.

:func:`edited_fingerprints` needs, for each document, the next one in descending doc_id.
Rows are dealt once to ranges of the sort key, whose bounds come from a bounded sample
(they only balance the ranges), and a window over each range reads the next row. The
first row of each range is added to the range before as well, so no row needs a task
that holds the whole order.

Defined cases: a null text is empty; an empty set has the fingerprint '' and likeness 1
to another empty one, 0 to any other. Null doc_ids come after all others. Rows that
share a doc_id are ordered by a hash of the text; of repeated rows each is followed by
the next one, so all but the last are followed by their equal. Equal texts have equal
fingerprints. Very long texts are handled whole, in one row. An empty table gives no
rows; a single document is its own next. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.llm.common import WS_CHARS, ascii_lower, nonnull, partitions, text_key

SHINGLE_WORDS = 5
BIN_BITS, LOW_BITS = 8, 4
BINS = 1 << BIN_BITS
SHIFT = 63 - BIN_BITS
MARK = (1 << SHIFT) - 1
PER_WORD = 64 // LOW_BITS
#: One bit for each packed value of a 64-bit integer.
UNITS = int("0001" * PER_WORD, 2)
PROBES = 4
#: Ranges of the order: several for each shuffle partition, one for 64 MB of text, and
#: not more than the driver can hold bounds for; the sample has so many keys a range.
RANGES_PER_PARTITION, RANGE_CHARS, MAX_RANGES, SAMPLE = 4, 64_000_000, 8192, 32

_draw = random.Random(12)
#: Probe order of each bin: odd steps and starts.
STEP = [2 * _draw.randrange(BINS // 2) + 1 for _ in range(BINS)]
START = [_draw.randrange(BINS) for _ in range(BINS)]
INVERSE = [pow(a, -1, BINS) for a in STEP]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _constants(values: list[int], kind: str = "int") -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def shingle_hashes(text: Column) -> Column:
    """A hash for each 5-word window of the text, or one for a shorter sequence."""
    spaced = F.translate(ascii_lower(text), WS_CHARS, " " * len(WS_CHARS))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    windows = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (SHINGLE_WORDS - 1)), lambda i: F.xxhash64(F.slice(h, i, SHINGLE_WORDS))
    )
    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= SHINGLE_WORDS, windows(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")),
    )


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(MARK)) == MARK


def _bin(value: Column) -> Column:
    return F.shiftright(value, SHIFT).cast("int")


def bin_minima(hashes: Column) -> Column:
    """The least 63-bit hash of each bin, or the bin's mark."""
    marks = _constants([j << SHIFT | MARK for j in range(BINS)], "bigint")
    ordered = F.sort_array(F.concat(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1)), marks))
    return _let(ordered, lambda s: F.filter(s, lambda v, i: (i == 0) | (_bin(F.get(s, i - 1)) != _bin(v))))


def densified(minima: Column) -> Column:
    """Values of all bins: an empty one takes that of the first occupied bin in its order."""
    step, start, inverse = _constants(STEP), _constants(START), _constants(INVERSE)
    within = lambda x: x.bitwiseAND(F.lit(BINS - 1))

    def filled(m: Column, occupied: Column) -> Column:
        def first_occupied(j: Column) -> Column:
            when_met = lambda o: within(F.get(inverse, j) * (_bin(o) - F.get(start, j)))
            met = F.array_min(F.transform(occupied, lambda o: when_met(o) * BINS + _bin(o)))
            return F.get(m, within(met))

        def of_bin(v: Column, j: Column) -> Column:
            out = F.when(~_empty(v), v)
            for t in range(PROBES):
                probed = F.get(m, within(F.get(step, j) * t + F.get(start, j)))
                out = out.when(~_empty(probed), probed)
            return out.otherwise(first_occupied(j))

        return F.when(F.size(occupied) == BINS, m).otherwise(F.transform(m, of_bin))

    return _let(minima, lambda m: _let(F.filter(m, lambda v: ~_empty(v)), lambda occupied: filled(m, occupied)))


def packed(values: Column) -> Column:
    """Low-order bits of all bins, 16 bins to a 64-bit integer."""
    low = F.transform(values, lambda v, j: F.xxhash64(v, j).bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    add = lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x)
    one = lambda bits, k: F.aggregate(F.slice(bits, k * PER_WORD + 1, PER_WORD), F.lit(0).cast("bigint"), add)
    return _let(low, lambda bits: F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda k: one(bits, k)))


def signature(text: Column) -> Column:
    """The packed fingerprint of a text; an empty array for an empty set."""
    return _let(
        shingle_hashes(text),
        lambda h: F.when(F.size(h) > 0, packed(densified(bin_minima(h)))).otherwise(F.array().cast("array<bigint>")),
    )


def as_text(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected estimate of the Jaccard similarity of two fingerprints' sets."""
    def equal(x: Column, y: Column) -> Column:
        folded = lambda d: F.shiftrightunsigned(d, 1).bitwiseOR(d)
        twice = lambda d: F.shiftrightunsigned(d, 2).bitwiseOR(d)
        return PER_WORD - F.bit_count(twice(folded(x.bitwiseXOR(y))).bitwiseAND(F.lit(UNITS)))

    share = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda acc, n: acc + n) / BINS
    chance = 1 / (1 << LOW_BITS)
    corrected = F.greatest((share - chance) / (1 - chance), F.lit(0.0))
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(corrected)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", signature(nonnull("text")).alias("sig")).select("doc_id", as_text(F.col("sig")).alias("fingerprint"))


# --- the next document -------------------------------------------------------------

#: Descending doc_id, nulls last; then the text's hash, then anything that parts equals.
ORDER = ["nulls", "down", "tk", "salt"]
KEY = "nulls int, down bigint, tk bigint, salt bigint"


def _keyed(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id").cast("long")
    return docs.select(
        d.alias("doc_id"), nonnull("text").alias("text"), d.isNull().cast("int").alias("nulls"),
        F.coalesce(F.bitwise_not(d), F.lit(0).cast("long")).alias("down"), text_key().alias("tk"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )


def _bounds(keyed: DataFrame) -> list[tuple]:
    """Upper ends of ranges of about equal size, from a bounded sample of the keys."""
    n, chars = keyed.agg(F.count("*"), F.sum(F.length("text"))).first()
    wanted = min(MAX_RANGES, max(RANGES_PER_PARTITION * partitions(keyed.sparkSession), (chars or 0) // RANGE_CHARS))
    keys = keyed.select(*ORDER)
    sample = sorted(map(tuple, keys.sample(min(1.0, SAMPLE * wanted / n), seed=5).collect())) if n else []
    return sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)}) if sample else []


def _range_of(bounds: list[tuple]) -> Column:
    """Number of bounds at or below the row's key, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, c, t in zip(b, ORDER, ("int", "long", "long", "long"))]) for b in bounds])
    key = F.struct(*ORDER)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    below = lambda at: (at <= len(bounds)) & F.coalesce(F.get(table, at - 1) <= key, F.lit(False))
    return F.aggregate(_constants(steps), F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def with_next(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, text and ``extra`` of each row (doc_id, text), and as next_<column> those
    of the row that follows in descending doc_id; the first follows the last."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    rows = keyed.withColumn("range", _range_of(_bounds(keyed)))
    # The first key of each range, one row a range; its text goes to the range before too.
    firsts = sorted((r["range"], *r["first"]) for r in rows.groupBy("range").agg(F.min(F.struct(*ORDER[:3])).alias("first")).collect())
    before = [(firsts[i - 1][0], *f[1:]) for i, f in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(before, "range int, nulls int, down bigint, tk bigint"))
    again = keyed.drop("salt").join(table, ["nulls", "down", "tk"]).groupBy("range", "nulls", "down", "tk").agg(F.max("text").alias("text"))
    again = again.select(F.lit(None).cast("long").alias("doc_id"), "text", "nulls", "down", "tk", F.lit(0).cast("long").alias("salt"), "range", F.lit(1).alias("again"))
    names = ["text", *[f"extra{i}" for i in range(len(extra))]]
    every = rows.withColumn("again", F.lit(0)).unionByName(again).withColumns(dict(zip(names[1:], extra)))
    w = Window.partitionBy("range").orderBy("again", *ORDER)
    out = every.select("doc_id", *names, "again", *[F.lead(c).over(w).alias(f"next_{c}") for c in names])
    return out.filter("again = 0").drop("again")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of each row of ``docs`` (doc_id, text). The edited text is the text with its
    last third (rounded down) replaced by as many first code points of the next document."""
    d = with_next(docs, signature(F.col("text")))
    third = F.floor(F.col("n") / 3).cast("int")
    d = d.withColumn("n", F.length("text")).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("extra0").alias("sig"), F.col("next_extra0").alias("next_sig"),
        F.concat(F.left("text", F.col("n") - third), F.left("next_text", third)).alias("edited"),
    )
    d = d.select("doc_id", "n_chars", "sig", "next_sig", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_sig"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
