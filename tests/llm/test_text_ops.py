"""Line dedup, exact dedup, quality rules, mixing and packing against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from skimdex.llm import exact_dedup, line_dedup, mixing, packing, quality_rules
from tests.llm.helpers import WS, empty, frame, rows, words

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, keep_first):
    data = rows()
    keyed = [(d, [x.strip(WS).translate(lower) for x in (t or "").split("\n")], (t or "").split("\n")) for d, t, *_ in data]
    docs_of = defaultdict(set)
    for d, keys, _ in keyed:
        for k in keys:
            docs_of[k].add(d)
    first = {}
    for d, keys, _ in sorted(keyed, key=lambda x: (x[0] is not None, x[0] or 0)):
        for i, k in enumerate(keys):
            first.setdefault(k, (d, i))
    want = []
    for d, keys, lines in keyed:
        gone = [bool(k) and len(docs_of[k]) >= 10 and not (keep_first and first[k] == (d, i)) for i, k in enumerate(keys)]
        want.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    got = [tuple(r) for r in line_dedup.line_dedup(frame(spark, data), keep_first=keep_first).collect()]
    assert Counter(got) == Counter(want)
    assert any(w[2] for w in want)


def test_exact_dedup(spark):
    data = rows()
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups["".join((t or "").translate({ord(c): None for c in WS}))].append((-len(t or ""), d is None, d or 0, d))
    got = exact_dedup.exact_dedup(frame(spark, data)).collect()
    assert len(got) == len(data)
    kept = Counter()
    for r in got:
        key = next(k for k in groups if sha(k) == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(groups[key])[3], len(groups[key]))
        kept[key] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.kept_rows(frame(spark, data)).count() == len(groups)


def test_cuckoo_filter_grows_and_deletes():
    keys = np.random.default_rng(1).integers(1, 1 << 63, 20_000, dtype=np.uint64)
    f = exact_dedup.filled(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(2).integers(1, 1 << 63, 20_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:5000])
    assert f.contains(keys[5000:]).all() and f.contains(keys[:5000]).mean() < 0.01
    assert not exact_dedup.CuckooFilter(2).insert(keys)  # overflow is reported


def test_index_insert_and_delete(spark):
    d = spark.createDataFrame([(i, f"text {i % 6}") for i in range(12)], "doc_id long, text string")
    dig = exact_dedup.digests(d).cache()
    index = exact_dedup.insert(exact_dedup.empty_index(spark), dig.filter("doc_id < 8"), 3)
    index = exact_dedup.insert(index, dig.filter("doc_id >= 8"), 3)
    assert sorted((r.doc_id, r.copies) for r in exact_dedup.keys(index).collect()) == [(i, 2) for i in range(6)]
    gone = "doc_id in (0, 6, 1)"
    index = exact_dedup.delete(index, dig.filter(gone), dig.filter(f"not {gone}"), 3)
    assert sorted((r.doc_id, r.copies) for r in exact_dedup.keys(index).collect()) == [(2, 2), (3, 2), (4, 2), (5, 2), (7, 1)]
    index = exact_dedup.insert(index, dig.filter("doc_id = 0"), 3)
    assert sorted((r.doc_id, r.copies) for r in exact_dedup.keys(index).collect()) == [(0, 1), (2, 2), (3, 2), (4, 2), (5, 2), (7, 1)]


def test_index_trusts_the_filter():
    """A miss is new without a look at the stored keys, a hit is compared with them."""
    shard = exact_dedup._Shard(pd.DataFrame(columns=["shard", "digest", "doc_id", "n_cp", "row_no", "copies", "filter"]))
    a, b = sha("a"), sha("b")
    shard.insert([(a, 1, 1, 1, 1), (a, 2, 1, 2, 1), (b, 3, 1, 3, 1)])
    assert {k: r[3] for k, r in shard.rows.items()} == {a: 2, b: 1}
    shard.filter.delete(exact_dedup._keys64([a]))
    shard.insert([(a, 9, 1, 9, 1)])
    assert shard.rows[a] == [9, 1, 9, 1]  # the filter alone said that it is new
    shard.filter.contains = lambda keys: np.ones(len(keys), bool)  # false positives only
    shard.insert([(sha("c"), 4, 1, 4, 1), (b, 5, 1, 5, 1)])
    assert {k: r[3] for k, r in shard.rows.items()} == {a: 1, b: 2, sha("c"): 1}


def _counts(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if x.strip(WS)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    data = rows(200, 5)
    got = quality_rules.quality_rules(frame(spark, data), min_group=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(data)
    for d, t, *_ in data:
        c = _counts(t)
        r = next(x for x in by[d] if x.word_chars == c[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)
    clean = [r for r in got if r.doc_id != 204 and not r.base_failed and r.n_symbols == 0 and r.n_dup_lines == 0]  # long texts too
    assert len(clean) > 50 and all(r.kept for r in clean)


def test_quality_rules_reject_symbol_texts(spark):
    r = random.Random(1)
    good = [(i, " ".join(f"word{r.randrange(9999)}" for _ in range(r.randrange(60, 400))), "en", "a") for i in range(150)]
    bad = [(1000 + i, " ".join(f"w{r.randrange(9999)}$$$" for _ in range(100)), "en", "a") for i in range(9)]
    got = {x.doc_id: x.kept for x in quality_rules.quality_rules(frame(spark, good + bad)).collect()}
    assert all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(9))


def test_quality_rules_reject_outliers_in_one_statistic(spark):
    r = random.Random(2)
    word = lambda: f"word{r.randrange(100_000, 999_999)}"
    text = lambda n: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n))
    good = [(i, text(r.randrange(15, 30)), "en", "a") for i in range(150)]
    symbols = "\n".join(" ".join(word() + ("#" if k < 3 else "") for k in range(10)) for _ in range(20))
    many = text(19) + "\n" + "\n".join([word()] * 20)  # short lines: half of them duplicate
    once = [word() for _ in range(48)]
    repeated = text(10) + "\n" + " ".join(once) + " " + word() + " " + " ".join(once)  # 96 of 197 words
    bad = [(1000, text(2200), "en", "a"), (1001, symbols, "en", "a"), (1002, many, "en", "a"), (1003, repeated, "en", "a")]
    bad += [(1004, " ".join("x" * 30 + word() for _ in range(200)), "en", "a")]
    got = {x.doc_id: x for x in quality_rules.quality_rules(frame(spark, good + bad)).collect()}
    assert sum(got[i].kept for i in range(150)) >= 149
    assert [got[d].base_failed for d, *_ in bad] == [False] * 5
    assert [got[d].kept for d, *_ in bad] == [False] * 5


def test_mixing(spark):
    data = rows(300, 9)
    got = mixing.mix(frame(spark, data)).collect()
    again = mixing.mix(frame(spark, data).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while True:  # share, stop the full ones, share again
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / w for s in open_})
            break
        for s in full:
            target[s] = 3 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    longest = {s: max(len(words(t)) for _, t, _, x in data if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in order)


@pytest.mark.parametrize("n_buckets", [1, 2, 3, 5])
def test_best_boundaries(n_buckets):
    r = random.Random(n_buckets)
    for _ in range(40):
        lengths = sorted(r.sample(range(0, 60), r.randrange(1, 9)))
        counts = [r.randrange(1, 9) for _ in lengths]

        def cost(ends):
            return sum(c * next(e for e in ends if e >= x) for x, c in zip(lengths, counts))

        found = packing.best_boundaries(lengths, counts, n_buckets)
        k = min(n_buckets, len(lengths))
        best = min(cost((*e, lengths[-1])) for m in range(k) for e in itertools.combinations(lengths[:-1], m))
        assert len(found) <= n_buckets and cost(found) == best


def test_packing(spark):
    data = rows(200, 4)
    got = packing.pack(frame(spark, data), n_buckets=4, budget=1000, shard_docs=50).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(words(t))) for d, t, *_ in data)
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches[r.bucket, r.shard, r.batch].append(r)
    for b in batches.values():
        assert len(b) * b[0].boundary <= 1000 or len(b) == 1
        assert sorted(r.slot for r in b) == list(range(len(b)))


def test_packing_is_optimal_for_long_texts(spark):
    lengths = [65_530, 65_537, 65_538, 70_001, 70_003, 99_991] * 3 + [70_001] * 20
    docs = spark.createDataFrame([(None, n) for n in lengths], "doc_id long, n long")
    got = packing.pack(docs, docs.n, n_buckets=3, shard_docs=4).collect()
    best = min(sum(min(e for e in (*ends, 99_991) if e >= n) - n for n in lengths) for ends in itertools.combinations(set(lengths) - {99_991}, 2))
    assert sum(r.padding for r in got) == best and sorted(r.n_tokens for r in got) == sorted(lengths)
    assert len({(r.bucket, r.shard) for r in got}) > 3  # rows without doc_id are dealt


def test_empty_tables(spark):
    e = empty(spark)
    for f in (line_dedup.line_dedup, exact_dedup.exact_dedup, quality_rules.quality_rules, mixing.mix, packing.pack):
        assert f(e).count() == 0
