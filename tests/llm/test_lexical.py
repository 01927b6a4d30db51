"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import pytest

from skimdex.llm import lexical
from tests.llm.helpers import empty, frame, rows, sentence

lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)) if t]


def plain(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted, scored = Counter(terms(text)), []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total if total else 0
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in wanted.items() if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(*x, 9, 9, 9) for x in items], "item_id long, text string, tid long, uid long, score long")


@pytest.mark.parametrize("top", [10, 2])
def test_against_plain(spark, monkeypatch, top):
    monkeypatch.setattr(lexical, "TOP", top)
    data = rows(120)
    r = random.Random(5)
    texts = [t for _, t, *_ in data if t]
    items = [(i, " ".join(r.choice(texts).split()[: r.choice([1, 3, 25])])) for i in range(25)]
    items += [(90, None), (91, "   "), (92, "absent-term"), (93, "read READ more Read"), (93, "ñandú w1 w2"), (None, "w3 w3 here"), (94, sentence(r, 300, 5000))]
    trace = []
    got = lexical.search(frame(spark, data), items_frame(spark, items), trace).collect()
    assert Counter(map(tuple, got)) == Counter(plain(data, items, top))
    assert trace[-1][2] == 0


def test_accumulators_stop_before_the_common_terms(spark):
    r = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    data = [(i, " ".join(r.sample(common, 20)), None, None) for i in range(400)]
    data += [(1000 + i, " ".join(r.sample(common, 20) + [f"rare{k}" for k in range(8)]), None, None) for i in range(15)]
    items = [(1, " ".join(common + [f"rare{k}" for k in range(8)]))]
    trace = []
    got = lexical.search(frame(spark, data), items_frame(spark, items), trace).collect()
    assert [tuple(x) for x in sorted(got, key=lambda x: x.rank)] == plain(data, items)
    assert trace[-1][0] < 38  # the round that ended it, of 38 terms
    query = lexical.query_terms(items_frame(spark, items))
    vocabulary = query.select("term").distinct().selectExpr("term", "xxhash64(term) & 65535 as tid")
    posted, known = lexical.postings(lexical.term_counts(frame(spark, data), vocabulary))
    found = lexical.survivors(posted, lexical.plan_items(query.join(vocabulary, "term"), known))
    assert {x.uid for x in found.collect()} and found.count() == 15  # of 415 documents that hold a term


def test_documents_of_equal_score_go_by_doc_id(spark):
    data = [(i, "same words here", None, None) for i in (5, 3, None, 3, 8)] + [(9, "other", None, None)]
    got = lexical.search(frame(spark, data), items_frame(spark, [(1, "words")])).collect()
    assert [x.doc_id for x in sorted(got, key=lambda x: x.rank)] == [3, 3, 5, 8, None]


def test_empty_tables(spark):
    none = items_frame(spark, [(1, "a")]).limit(0)
    assert lexical.search(empty(spark), items_frame(spark, [(1, "a")])).collect() == []
    assert lexical.search(frame(spark, rows(5)), none).collect() == []
    assert lexical.search(frame(spark, [(1, None, None, None)]), items_frame(spark, [(1, "a")])).collect() == []


def test_long_documents_do_not_overflow(spark):
    d = spark.createDataFrame([(1, 10**9, 4), (1, 5, 4)], "tid long, n long, tf long")
    got = [r[0] for r in d.select(lexical._impact(3 * 10**10, 10**13)).collect()]
    assert got == [4 * 10**9 // (4000 + 8 * (25 + 75 * n * 3 * 10**10 // 10**13)) for n in (10**9, 5)]
