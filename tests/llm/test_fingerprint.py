"""Fingerprints against a plain version, and their likeness against exact sets."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from skimdex.llm import fingerprint as fp
from tests.llm.helpers import WS, empty, frame, rows, sentence

lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chained(parts):
    """Spark's xxhash64 of several values: each is hashed with the hash so far as seed."""
    h = 42
    for x in parts:
        h = xxhash.xxh64(x, seed=h).intdigest()
    return h


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.translate(lower)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(text):
    hashes = [chained([chained([w.encode()]).to_bytes(8, "little") for w in s]) >> 1 for s in shingles(text)]
    if not hashes:
        return ""
    least = {}
    for h in hashes:
        least[h >> fp.SHIFT] = min(h, least.get(h >> fp.SHIFT, h))
    bits = ""
    for j in range(fp.BINS):
        at, t = j, 0
        while at not in least:
            at, t = (fp.STEP[j] * t + fp.START[j]) % fp.BINS, t + 1
        bits += f"{chained([least[at].to_bytes(8, 'little'), j.to_bytes(4, 'little')]) & 15:x}"
    return bits


def near(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / fp.BINS - 1 / 16) / (15 / 16))


def expected(data):
    tk = lambda t: int.from_bytes(xxhash.xxh64((t or "").encode(), seed=42).intdigest().to_bytes(8, "big"), "big", signed=True)
    order = sorted(((d, t or "") for d, t, *_ in data), key=lambda x: (x[0] is None, -(x[0] or 0), tk(x[1])))
    out = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        a, b = plain(t), plain(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, plain(after)), 9)))
    return out


@pytest.mark.parametrize("per_partition", [1, 9])
def test_against_plain(spark, monkeypatch, per_partition):
    monkeypatch.setattr(fp, "RANGES_PER_PARTITION", per_partition)
    data = [(d, t[:9000] if t else t, la, s) for d, t, la, s in rows()]
    data += [(-5, "one", "en", "a"), (-6, "Two  words", "en", "a"), (-7, "two\twords", "en", "a"), (-8, sentence(random.Random(3), 7), "en", "a")]
    got = fp.edited_fingerprints(frame(spark, data)).withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")}).collect()
    assert Counter(map(tuple, got)) == Counter(expected(data))
    assert {len(r.fingerprint) for r in got} == {0, 256}


def test_hot_doc_id_spreads_over_ranges(spark):
    data = [(7, "the same text again and again here", "en", "a")] * 300 + [(i, f"text {i} of its own with words", "en", "a") for i in range(20)]
    got = fp.edited_fingerprints(frame(spark, data)).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(x[:3] for x in expected(data))
    keyed = fp._keyed(frame(spark, data))
    sizes = keyed.withColumn("range", fp._range_of(fp._bounds(keyed))).groupBy("range").count().collect()
    assert max(r["count"] for r in sizes) < 100


def test_likeness_is_unbiased(spark):
    r = random.Random(8)
    pairs = []
    for n in (6, 30, 150, 2000):
        for _ in range(60):
            base = [f"w{r.randrange(10**6)}" for _ in range(n)]
            k = r.randrange(n)
            other = base[:k] + [f"v{r.randrange(10**6)}" for _ in range(n - k)]
            pairs.append((n, " ".join(base), " ".join(other)))
    d = spark.createDataFrame(pairs, "n int, a string, b string").repartition(4)
    d = d.select("n", "a", "b", fp.signature(F.col("a")).alias("x"), fp.signature(F.col("b")).alias("y"))
    errors = {}
    for row in d.select("n", "a", "b", fp.likeness(F.col("x"), F.col("y")).alias("got")).collect():
        a, b = shingles(row.a), shingles(row.b)
        errors.setdefault(row.n, []).append(row.got - len(a & b) / len(a | b))
    for n, e in errors.items():
        assert abs(sum(e) / len(e)) < 0.02, (n, sum(e) / len(e))
        assert max(map(abs, e)) < (0.5 if n < 20 else 0.14), n


def test_few_rows(spark):
    assert fp.edited_fingerprints(empty(spark)).collect() == []
    one = fp.edited_fingerprints(frame(spark, [(3, "a single document of six words", "en", "a")])).first()
    assert one.near_next == 1.0 and one.n_chars == 30
    only = fp.edited_fingerprints(frame(spark, [(None, None, None, None)])).first()
    assert (only.fingerprint, only.near_edited, only.near_next) == ("", 1.0, 1.0)
    assert [r.fingerprint for r in fp.fingerprints(frame(spark, [(1, WS, None, None)])).collect()] == [""]


def test_no_python_in_the_plan(spark):
    plan = fp.edited_fingerprints(frame(spark, rows())).withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
