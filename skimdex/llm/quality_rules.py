"""Quality rules: counts per document and robust multivariate outliers.

Counts of each whole text are transformed to a vector of five statistics. For
every language and source a minimum-covariance-determinant estimate (location and
scatter of the `SUPPORT` share of documents that lie closest together) is found by
concentration steps over all documents from `STARTS` starts, of which the one with
the least determinant stays; scatter is scaled to be consistent for a normal
distribution, and a document whose squared Mahalanobis distance exceeds `CUTOFF`, a
chi-square quantile, is rejected. Groups below `MIN_GROUP` documents are
pooled by language, then all together; pools below it aren't judged.

Statistics are whole multiples of 1/`SCALE` and their sums are exact decimals, so
the estimates don't depend on the order of rows. Each group takes one row of
parameters, and the steps see (group, vector) rows only, never texts.

Defined cases: null or empty text has no words and fails the base rules; null lang
or source counts as empty; repeated rows are judged each and count each; ties need
no order; no rows in, no rows out; a text of any length is counted whole and has to
fit a task; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.llm.common import WS_RE, bounded_broadcast, delete_ws, nonnull, stage, strip_ws, text_key

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SCALE = 1024
SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 50
#: Starts of the estimate: all documents, and single documents chosen by hash.
STARTS = 4
#: Standard deviation that counting alone gives, which each statistic has at least:
#: a quarter of the length; the mean of 50 words; one symbol in 50 words; one
#: duplicate line in 30; one repeated window in 150 words.
FLOORS = {"x0": 0.25, "x1": 0.06, "x2": 0.18, "x3": 0.3, "x4": 0.33}
X = tuple(FLOORS)


def _chi2_cdf(x: float, df: int) -> float:
    """Of an odd number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(1, df, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def _chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def _consistency(support: float) -> float:
    """What scatter of the closest ``support`` share is multiplied by."""
    return support / _chi2_cdf(_chi2_quantile(support, len(X)), len(X) + 2) if support < 1 else 1.0


#: One clean document in a thousand lies beyond it.
CUTOFF = _chi2_quantile(0.999, len(X))
DIST_BINS = 64


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: delete_ws(x) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _trigrams(words: Column) -> Column:
    """Hash of the 3-word window at each position it starts."""
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash,
    position), keep positions with an equal neighbour, add up what each covers
    before the next one starts."""
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        same = lambda a, b: a["h"] == b["h"]
        kept = F.filter(
            p, lambda x, k: F.coalesce(same(x, F.get(p, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k - 1)), F.lit(False))
        )
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    def cover(pos: Column) -> Column:
        steps = F.transform(pos, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    return _let(pairs, lambda p: _let(twice(p), cover))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tk, lang, source and the base counts of each row."""
    text = F.col("text")
    d = docs.select("doc_id", text_key().alias("tk"), nonnull("lang").alias("lang"), nonnull("source").alias("source"), nonnull("text").alias("text"))
    grams = _let(
        F.filter(F.split(strip_ws(text), WS_RE + "+"), lambda w: w != ""),
        lambda words: F.struct(F.size(words).cast("long").alias("n_words"), _trigrams(words).alias("grams")),
    )
    repeated = _let(
        F.col("w.grams"),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(g)),
    )
    return (
        d.withColumns(
            {
                "w": grams,
                "word_chars": F.length(delete_ws(text)).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": _dup_lines(text),
                "n_lines": F.size(F.split(text, "\n", -1)).cast("long"),
            }
        )
        .select("doc_id", "tk", "lang", "source", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_lines", repeated.alias("n_repeat_words"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def vectors(counts: DataFrame) -> DataFrame:
    """Adds the transformed statistics x0..x4 in units of 1/SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    stats = (
        F.log1p(n),
        F.log1p(F.col("word_chars") / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.log1p(10 * F.col("n_dup_lines") / F.col("n_lines")),
        F.log1p(10 * F.col("n_repeat_words") / n),
    )
    return counts.withColumns({x: F.round(s * SCALE).cast("long") for x, s in zip(X, stats)})


def with_groups(v: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds `g`: language and source, or the pool that a small group falls to."""
    sizes = v.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    by_lang = Window.partitionBy("lang")
    pooled = sizes.withColumn("pool", F.sum(F.when(F.col("n") < min_group, F.col("n"))).over(by_lang))
    name = (
        F.when(F.col("n") >= min_group, F.concat(F.lit("s"), F.col("lang"), F.lit("\n"), F.col("source")))
        .when(F.col("pool") >= min_group, F.concat(F.lit("l"), F.col("lang")))
        .otherwise(F.lit("all"))
    )
    groups = stage(pooled.select("lang", "source", name.alias("g")), "groups")
    return v.join(bounded_broadcast(groups, groups.count(), 200), ["lang", "source"])


def _params(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    """Location m_i and the lower Cholesky factor l_i_j of ``factor`` times the
    scatter of each group, over ``rows``; one row per group."""
    dec = "decimal(20,0)"
    pairs = [(i, j) for i in range(len(X)) for j in range(i + 1)]
    p = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(x).cast(dec)).cast("double").alias(f"s{i}") for i, x in enumerate(X)],
        *[F.sum((F.col(X[i]) * F.col(X[j])).cast(dec)).cast("double").alias(f"q{i}_{j}") for i, j in pairs],
    )
    p = p.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(X))})
    cov = {}
    for i, j in pairs:
        c = (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        cov[f"c{i}_{j}"] = F.greatest(c, F.lit(0.0)) + (FLOORS[X[i]] * SCALE) ** 2 if i == j else c
    p = p.withColumns(cov)
    for i, j in pairs:
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        p = p.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}_{j}"))
    return p.select("g", "n", *[f"m{i}" for i in range(len(X))], *[f"l{i}_{j}" for i, j in pairs])


def with_distance(v: DataFrame, params: DataFrame) -> DataFrame:
    """Adds `d2`, the squared Mahalanobis distance under the group's estimate."""
    out = v.join(params, "g", "left")
    for i in range(len(X)):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(X))), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", d2).select(*v.columns, "n", "d2")


def _closest(dist: DataFrame, support: float) -> DataFrame:
    """The bin of ln(d2) up to which `support` of each group lies: a histogram
    per group, so no group is sorted or gathered."""
    bins = dist.groupBy("g", _bin("d2").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("g").orderBy("bin")
    whole = Window.partitionBy("g")
    return (
        bins.withColumn("upto", F.sum("k").over(upto))
        .withColumn("all", F.sum("k").over(whole))
        .filter(F.col("upto") >= support * F.col("all"))
        .groupBy("g")
        .agg(F.min("bin").alias("last"))
    )


def _bin(d2: str) -> Column:
    return F.floor(F.log(F.greatest(F.col(d2), F.lit(1e-9))) * DIST_BINS).cast("int")


def _single(v: DataFrame, start: int) -> DataFrame:
    """Parameters as of `_params` around one document of each group, chosen by hash,
    with the floors as scatter."""
    one = v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64(*X, F.lit(start)).alias("h"), *X)).alias("d"))
    m = [F.col(f"d.{x}").cast("double").alias(f"m{i}") for i, x in enumerate(X)]
    return one.select("g", "n", *m, *[F.lit(FLOORS[X[i]] * SCALE if i == j else 0.0).alias(f"l{i}_{j}") for i in range(len(X)) for j in range(i + 1)])


def robust_estimates(v: DataFrame, support: float = SUPPORT, steps: int = STEPS, starts: int = STARTS) -> DataFrame:
    """Concentration steps: estimate, keep the closest share, estimate again, from
    each start; of each group the estimate with the least determinant. ``v`` has g
    and x0..x4 of the documents that count."""
    n_groups = v.select("g").distinct().count() * starts
    small = lambda df: bounded_broadcast(df, n_groups, 300)
    named = lambda df, k: df.withColumn("g", F.concat(F.chr(F.lit(65) + k), "g"))
    params = named(_params(v), F.lit(0))
    for k in range(1, starts):
        params = params.unionByName(named(_single(v, k), F.lit(k)))
    params = stage(params, "mcd")
    each = named(v.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))), F.col("start")).drop("start")
    for _ in range(steps):
        dist = with_distance(each, small(params)).drop("n")
        near = dist.join(small(_closest(dist, support)), "g").filter(_bin("d2") <= F.col("last"))
        params = stage(_params(near, _consistency(support)), "mcd")
    size = sum((F.log(F.col(f"l{i}_{i}")) for i in range(1, len(X))), F.log("l0_0"))
    values = [c for c in params.columns if c != "g"]
    best = params.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.min(F.struct(size.alias("size"), F.col("g").alias("start"), *values)).alias("p"))
    return stage(best.select("g", *[f"p.{c}" for c in values]), "mcd")


def quality_rules(docs: DataFrame, support: float = SUPPORT, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, group, squared distance and verdict (`kept`) of every row."""
    v = stage(with_groups(vectors(stage(text_counts(docs), "counts")), min_group), "vectors")
    params = robust_estimates(v.filter(~F.col("base_failed")).select("g", *X), support)
    n_groups = params.count()
    judged = with_distance(v, bounded_broadcast(params, n_groups, 300))
    # Scatter of the closest share is smaller than that of all; `n` counts it.
    far = (F.col("n") >= support * min_group) & (F.col("d2") > cutoff)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
