"""Language id by interpolated Kneser-Ney character models.

Texts are lower-cased, runs of other characters than letters become one space, and
each language gets a trigram model with absolute discounts: raw counts for trigrams,
continuation counts below. A trigram is packed into 63 bits, so the model is a sorted
array of exact keys with one log-probability for each language. The prediction is the
language with the lowest cross-entropy per character.

Counts, continuation counts and discounts cover all texts that may be learned from,
as tables in Spark. A task holds the log-probabilities of the trigrams most frequent in
all texts asked about, as many as fit `HELD_CELLS` numbers; this choice is a cache and
changes no result. All other trigrams of a text, seen in learning or not, are looked
up in the full tables by a join of distinct keys and come back as sums. Sums are whole
numbers (logarithms in units of 1 / `SCALE`), so entropies are the same for any
`HELD_CELLS`. One learned document in `CALIBRATION` is kept out of the
counts; the margin between the two best languages there gives the share of right
answers for each margin (made monotone), which is the score, and their entropies give
the limit beyond which a text is no language the model knows. `rejected` marks both.

Defined cases: null text and texts without a letter are `und` with score 0; rows with
null lang are predicted, not learned from; a null doc_id has remainder 0; with nothing
to learn from all are `und`; equal entropies go to the first language by code point;
repeated rows count and are answered each; no rows in, no rows out; a text of any
length is one row, whose trigrams (8 bytes each) a task holds once, not once for each
language; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import ship, stage

ship(__name__)
FOLDS, HELD_OUT = 3, 1
CALIBRATION = 10
#: Numbers (trigrams x languages, 4 bytes each) that a task holds.
HELD_CELLS = 4_000_000
SCALE = 1 << 24
MIN_SCORE = 0.5
ENTROPY_SD = 6.0
MARGIN_BINS, BINS_PER_NAT = 64, 40
CHUNK = 1 << 20
SPACE = 32
#: Letters are in the planes below.
PLANES = 0x40000
_TABLE: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to its lower-case letter, or to a space; made once in a task."""
    if not _TABLE:
        table = np.full(PLANES + 1, SPACE, np.int64)
        for i in range(PLANES):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLE.append(table)
    return _TABLE[0]


def letters(text: str) -> np.ndarray:
    """Folded code points with a space before and after, runs as one."""
    cp = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = _fold()[np.minimum(cp, PLANES)]
    return cp[np.concatenate(([True], (cp[1:] != SPACE) | (cp[:-1] != SPACE)))]


def trigrams(cp: np.ndarray) -> np.ndarray:
    return (cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:] if len(cp) > 2 else np.empty(0, np.int64)


def has_letter(text: str | None) -> bool:
    """By the rule that folds letters, so a text with a letter has a trigram."""
    return text is not None and any(c.isalpha() and ord(c) < PLANES for c in text)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(n, start)


def _count(batches):
    """Counts of (lang, trigram) within a partition, flushed when they grow."""
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "key": keys, "n": n})

    for batch in batches:
        waiting: dict[str, list] = {}
        chars = 0
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for i, (lang, text) in enumerate(rows):
            g = trigrams(letters(text or ""))
            if len(g):
                waiting.setdefault(lang, []).append(g)
                chars += len(g)
            if chars >= CHUNK or i == len(rows) - 1:
                for k, parts in waiting.items():
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    held.setdefault(k, []).append((keys, n.astype(np.int64)))
                    size += len(keys)
                waiting, chars = {}, 0
        if size > 2_000_000:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of (lang, text)."""
    return labelled.select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


LOW2, LOW1 = (1 << 42) - 1, (1 << 21) - 1


@dataclass(frozen=True)
class Tables:
    """Kneser-Ney counts of all languages. Per trigram, context and pair there is a
    table (key, held), ``held`` with one (l, n, k) for each language that has it: the
    count of a trigram; the tokens and types after a context; the types before a
    pair. What goes by one letter is arrays (letter, language) on the driver, bounded
    by the letters there are."""

    langs: tuple[str, ...]
    by_key: DataFrame
    by_context: DataFrame
    by_pair: DataFrame
    d3: np.ndarray
    d2: np.ndarray
    middle: np.ndarray
    total2: np.ndarray
    types2: np.ndarray
    last: np.ndarray
    p1: np.ndarray
    p1_other: np.ndarray


HELD = "key long, logs array<long>"


def _dense(held: pa.Array, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """n and k of a column of lists of (l, n, k), as (row, language); nulls are zero."""
    sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    flat = held.flatten()
    row, lang = np.repeat(np.arange(len(held)), sizes), flat.field("l").to_numpy()
    n, k = np.zeros((len(held), n_langs)), np.zeros((len(held), n_langs))
    n[row, lang], k[row, lang] = flat.field("n").to_numpy(), flat.field("k").to_numpy()
    return n, k


def _held(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("l", "n", "k")).alias("held"))


def _discounts(counted: DataFrame, n_langs: int) -> np.ndarray:
    """Share of counts of one against counts of two for each language."""
    out = np.full(n_langs, 0.5)
    for r in counted.groupBy("l").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():
        if r["one"] and r["two"]:
            out[r["l"]] = r["one"] / (r["one"] + 2 * r["two"])
    return out


def _by_letter(rows: DataFrame, n_langs: int, *cols: str) -> tuple[np.ndarray, ...]:
    """Sorted letters, and an array (letter, language) of each column."""
    got = rows.toPandas()
    letter, at = np.unique(got["letter"].to_numpy(np.int64), return_inverse=True)
    out = [np.zeros((len(letter), n_langs)) for _ in cols]
    for x, c in zip(out, cols):
        x[at, got["l"].to_numpy()] = got[c].to_numpy(np.float64)
    return letter, *out


def tables(counts: DataFrame, langs: list[str]) -> Tables:
    """From (lang, key, n); rows of other or no languages are left out."""
    index = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    full = counts.filter(F.col("lang").isNotNull()).select(index[F.col("lang")].alias("l"), "key", "n", F.lit(1).cast("long").alias("k"))
    context = full.groupBy("l", F.shiftright("key", 21).alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    pairs = full.groupBy("l", F.col("key").bitwiseAND(F.lit(LOW2)).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1).cast("long"))
    pairs = stage(pairs, "pairs")
    letter = F.shiftright("key", 21).alias("letter")
    middle, total2, types2 = _by_letter(pairs.groupBy("l", letter).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")), len(langs), "n", "k")
    last, n1 = _by_letter(pairs.groupBy("l", F.col("key").bitwiseAND(F.lit(LOW1)).alias("letter")).agg(F.count(F.lit(1)).alias("n")), len(langs), "n")
    total1 = np.maximum(n1.sum(axis=0), 1.0)
    d1 = np.array([_discount(x) for x in n1.T])
    other = np.maximum(d1 * (n1 > 0).sum(axis=0) / total1, 1e-9) / (len(last) + 1)
    return Tables(
        tuple(langs),
        stage(_held(full, "key"), "by_key"),
        stage(_held(context, "key"), "by_context"),
        stage(_held(pairs, "key"), "by_pair"),
        _discounts(full, len(langs)),
        _discounts(pairs, len(langs)),
        middle,
        total2,
        types2,
        last,
        np.maximum(n1 - d1, 0) / total1 + other,
        other,
    )


def _logs(t: Tables):
    """mapInArrow function: key and the three lists it was joined with come in, the
    logarithm for each language goes out, in units of 1 / SCALE."""
    n_langs, d3, d2, letter2, total2, types2, letter1, p1, other = len(t.langs), t.d3, t.d2, t.middle, t.total2, t.types2, t.last, t.p1, t.p1_other

    def at_letter(letter, values, wanted, default):
        at, there = _at(letter, wanted)
        return np.where(there[:, None], values[at], default) if len(letter) else np.zeros((len(wanted), n_langs)) + default

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            n3, _ = _dense(batch.column(1), n_langs)
            total3, types3 = _dense(batch.column(2), n_langs)
            n2, _ = _dense(batch.column(3), n_langs)
            low = at_letter(letter1, p1, keys & LOW1, other)
            b = (keys >> 21) & LOW1
            total = at_letter(letter2, total2, b, 0.0)
            rest = np.where(total > 0, d2 * at_letter(letter2, types2, b, 0.0) / np.maximum(total, 1), 1.0)
            low = np.maximum(n2 - d2, 0) / np.maximum(total, 1) + rest * low
            rest = np.where(total3 > 0, d3 * types3 / np.maximum(total3, 1), 1.0)
            p = np.maximum(n3 - d3, 0) / np.maximum(total3, 1) + rest * low
            logs = np.rint(np.log(p) * SCALE).astype(np.int64)
            offsets = np.arange(0, logs.size + 1, n_langs, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, logs.ravel())], names=["key", "logs"])

    return run


def log_probabilities(t: Tables, wanted: DataFrame) -> DataFrame:
    """(key, logs) of the distinct trigrams ``wanted``, seen or not, from the full
    tables by joins; logs has a value for each language."""

    def of(table: DataFrame, on: str, name: str) -> DataFrame:
        return table.select(F.col("key").alias(on), F.col("held").alias(name))

    w = wanted.select("key", F.shiftright("key", 21).alias("context"), F.col("key").bitwiseAND(F.lit(LOW2)).alias("pair"))
    w = w.join(of(t.by_key, "key", "n3"), "key", "left").join(of(t.by_context, "context", "t3"), "context", "left").join(of(t.by_pair, "pair", "n2"), "pair", "left")
    return w.select("key", "n3", "t3", "n2").mapInArrow(_logs(t), HELD)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` keys, whole quarter-octaves of frequency from the top, by a
    histogram."""
    total = counts.groupBy("key").agg(F.sum("n").alias("n")).withColumn("octave", F.floor(F.log2("n") * 4).cast("int"))
    least, held = None, 0
    for r in sorted(total.groupBy("octave").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["octave"]):
        held += r["k"]
        if held > limit:
            break
        least = r["octave"]
    return total.filter(F.col("octave") >= least).select("key") if least is not None else total.limit(0).select("key")


class Held:
    """Log probabilities of the trigrams a task has at hand: sorted keys, an array
    (language, key), and a last column of zeros for all others."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys = keys
        self.logs = np.concatenate([logs, np.zeros((len(logs), 1), np.int32)], axis=1)

    def sums(self, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of each text, (text, language), and which keys are not held. ``keys``
        are those of several texts, none empty, that begin at ``starts``."""
        at, there = _at(self.keys, keys)
        at = np.where(there, at, len(self.keys))
        return np.stack([np.add.reduceat(x[at], starts, dtype=np.int64) for x in self.logs], axis=1), ~there


def _scored(held: Held, n_other: int):
    """mapInArrow function: text and ``n_other`` more columns come in; the others go
    out with n, the trigrams of the text (null if none), sums, a number for each
    language over those held, and rest, the (key, times) that are not held."""
    n_langs = len(held.logs)
    pair = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))

    def answer(grams):
        sizes = np.array([len(g) for g in grams])
        ends = np.cumsum(sizes)
        keys = np.concatenate(grams)
        sums, missing = held.sums(keys, ends - sizes)
        rest = [None] * len(grams)
        if missing.any():
            text = np.repeat(np.arange(len(grams)), sizes)[missing]
            bounds = np.searchsorted(text, np.arange(len(grams) + 1))
            other = keys[missing]
            for i in np.unique(text):
                k, n = np.unique(other[bounds[i] : bounds[i + 1]], return_counts=True)
                rest[i] = [{"key": int(a), "times": int(b)} for a, b in zip(k, n)]
        return list(zip(sizes.tolist(), sums.tolist(), rest))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out, rows, grams, size = [(None, [0] * n_langs, None)] * len(texts), [], [], 0
            for i, t in enumerate(texts):
                g = trigrams(letters(t or ""))
                if len(g):
                    rows.append(i)
                    grams.append(g)
                    size += len(g)
                if rows and (size >= CHUNK or i == len(texts) - 1):
                    for r, a in zip(rows, answer(grams)):
                        out[r] = a
                    rows, grams, size = [], [], 0
            cols = [batch.column(1 + i) for i in range(n_other)]
            cols += [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pair)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[1 : 1 + n_other], "n", "sums", "rest"])

    return run


def score_rows(df: DataFrame, t: Tables, held: Held) -> DataFrame:
    """The columns of ``df`` but text, with lang_pred, entropy and margin. Trigrams
    that a task does not hold go by (row, key) to the full tables and come back as
    sums; all sums are whole numbers, so it makes no difference which are held."""
    others = [c for c in df.columns if c != "text"]
    types = dict(df.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in others) + "n long, sums array<long>, rest array<struct<key:bigint,times:bigint>>"
    out = df.select("text", *others).mapInArrow(_scored(held, len(others)), schema)
    out = stage(out.withColumn("row", F.monotonically_increasing_id()), "sums")
    asked = out.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.times")
    if asked.limit(1).count():
        logs = stage(log_probabilities(t, asked.select("key").distinct()), "logs")
        back = asked.join(logs, "key").groupBy("row").agg(*[F.sum(F.col("logs")[i] * F.col("times")).alias(f"l{i}") for i in range(len(t.langs))])
        back = back.select("row", F.array(*[F.col(f"l{i}") for i in range(len(t.langs))]).alias("more"))
        out = out.drop("rest").join(back, "row", "left")
        sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    else:
        sums = F.col("sums")
    entropies = F.when(F.col("n").isNotNull(), F.transform(sums, lambda x: -x / F.lit(float(SCALE)) / F.col("n")))
    out = out.select(*others, entropies.alias("e")).withColumns({"entropy": F.array_min("e"), "two": F.slice(F.array_sort("e"), 1, 2)})
    best = F.element_at(F.array(*[F.lit(x) for x in t.langs]), F.array_position("e", F.col("entropy")).cast("int"))
    margin = F.when(F.size("two") > 1, F.least(F.col("two")[1] - F.col("two")[0], F.lit(1e3))).when(F.col("entropy").isNotNull(), F.lit(1e3))
    return out.select(*others, F.when(F.col("entropy").isNull(), F.lit("und")).otherwise(best).alias("lang_pred"), "entropy", margin.alias("margin"))


def _margin_bin(margin: Column) -> Column:
    return F.least(F.floor(margin * BINS_PER_NAT), F.lit(MARGIN_BINS - 1)).cast("int")


def calibrate(scored: DataFrame) -> tuple[list[float], dict[str, float]]:
    """Share of right answers by margin bin, pooled until it never falls, and the
    entropy limit of each language. ``scored`` has `lang`, the right answer."""
    known = scored.filter(F.col("entropy").isNotNull())
    right = (F.col("lang") == F.col("lang_pred")).cast("long")
    bins = {r["b"]: (r["r"], r["n"]) for r in known.groupBy(_margin_bin(F.col("margin")).alias("b")).agg(F.sum(right).alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    pools: list[list[float]] = []  # share of right answers, weight, bins
    for b in range(MARGIN_BINS):
        r, n = bins.get(b, (0, 0))
        prior = 1 - 0.5 * 0.8**b
        pools.append([(r + 2 * prior) / (n + 2), n + 2, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            y, w, k = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + y * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2] + k]
    shares = [y for y, _, k in pools for _ in range(k)]
    limits = {
        r["lang_pred"]: r["m"] + ENTROPY_SD * max(r["s"] or 0.0, 0.02)
        for r in known.filter(right == 1).groupBy("lang_pred").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s")).collect()
    }
    return shares, limits


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def train(rows: DataFrame, teach: Column, cells: int = HELD_CELLS) -> tuple[Tables, Held] | None:
    """The full tables from the rows whose language ``teach`` is not null, and the
    trigrams most frequent in all ``rows`` for the tasks."""
    counts = stage(trigram_counts(rows.select(teach.alias("lang"), "text")), "trigrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect() if r["lang"] is not None)
    if not langs:
        return None
    t = tables(counts, langs)
    got = log_probabilities(t, most_frequent(counts, cells // len(langs))).select("key", *[F.col("logs")[i].cast("int").alias(f"l{i}") for i in range(len(langs))])
    got = got.toPandas().sort_values("key")
    return t, Held(got["key"].to_numpy(np.int64), np.stack([got[f"l{i}"].to_numpy(np.int32) for i in range(len(langs))]))


def language_id(docs: DataFrame, cells: int = HELD_CELLS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, margin, rejected of each row."""
    d = docs.select("doc_id", "text", "lang").withColumn("held_out", fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
    known = F.when(~F.col("held_out") & F.col("text").isNotNull(), F.col("lang"))
    kept_out = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(CALIBRATION)) == 0, F.lit(False))
    trained = train(d, F.when(~kept_out, known), cells) or train(d, known, cells)
    if trained is None:
        none = F.lit(None).cast("double")
        return d.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("entropy"), none.alias("margin"), F.lit(True).alias("rejected"))
    rows = d.select("doc_id", "text", "held_out", F.when(kept_out, known).alias("lang"))
    scored = stage(score_rows(rows, *trained), "scored")
    shares, limits = calibrate(scored.filter(F.col("lang").isNotNull()))
    score = F.when(F.col("margin").isNull(), F.lit(0.0)).otherwise(
        F.element_at(F.array(*[F.lit(float(s)) for s in shares]), _margin_bin(F.col("margin")) + 1)
    )
    limit = F.lit(float("inf"))
    for lang, most in limits.items():
        limit = F.when(F.col("lang_pred") == lang, F.lit(float(most))).otherwise(limit)
    return (
        scored.withColumn("score", score)
        .withColumn("rejected", F.col("entropy").isNull() | (F.col("score") < MIN_SCORE) | (F.col("entropy") > limit))
        .select("doc_id", "held_out", "lang_pred", "score", "entropy", "margin", "rejected")
    )
