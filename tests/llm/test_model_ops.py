"""Near-duplicates and suffix dedup against brute force, language id by held-out
accuracy, URL filters and chat formatting by rule, and the pipeline."""

import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skimdex.llm import chat_format, components, lang_id, minhash_forest, suffix_dedup, url_filter
from skimdex.session import shared_dir
from tests.llm.helpers import empty, frame, rows


def _sets(data):
    out = []
    for d, t, *_ in data:
        w = (t or "").encode().lower().split()
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def test_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "BLOCK", 3)  # classes of several blocks
    data = rows(80)
    r = random.Random(2)
    base = [f"t{r.randrange(9999)}" for _ in range(120)]
    for i in range(25):  # a crowd of near copies, one word apart
        data.append((200 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), "en", "a"))
    sets = [(d, s) for d, s in _sets(data) if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    got = minhash_forest.near_dedup(frame(spark, data)).collect()
    assert len(got) == len(data)
    size = dict(sets)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.component_id, x.n_shingles) == (find(x.doc_id), len(size[x.doc_id]))
            assert x.kept == (x.doc_id == x.component_id)
    assert len({find(200 + i) for i in range(25)}) == 1


def test_near_dedup_links_a_star_of_copies(spark):
    r = random.Random(11)
    base = [f"b{i}" for i in range(500)]
    data, at = [(0, " ".join(base), "en", "a")], range(20, 480, 42)
    for i in range(1, 2001):
        w = list(base)
        for k in at:
            w[k + r.randrange(36)] = f"n{i}_{k}"
        data.append((i, " ".join(w), "en", "a"))
    sets = dict(_sets(data))

    def near(s, t):
        return 100 * len(s & t) >= 75 * len(s | t)

    assert all(near(sets[0], sets[i]) for i in range(1, 2001))
    assert sum(near(sets[i], sets[i + 1]) for i in range(1, 2000)) < 20
    assert {x.component_id for x in minhash_forest.near_dedup(frame(spark, data)).collect()} == {0}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_of_a_long_ascending_path(spark):
    path = spark.range(3000).selectExpr("id a", "id + 1 b")
    got = components.components(path).collect()
    assert len(got) == 3001 and {x.root for x in got} == {0}


@pytest.mark.parametrize("hot", [100_000, 4])
def test_suffix_dedup(spark, hot):
    data = rows(50)
    seen, want = {}, {}
    for d, t, *_ in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = suffix_dedup.suffix_dedup(frame(spark, data), hot=hot).collect()
    assert len(got) == len(data)
    for x in got:
        if x.doc_id is None:
            assert x.n_removed == 0
        else:
            assert tuple(x)[1:] == want[x.doc_id], x.doc_id
    assert sum(w[1] > 0 for w in want.values()) > 5


def test_blind_trie_orders():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.insert(s, i)
    classes = [[strings[i] for i in c] for c in trie.classes()]
    assert all(len(set(c)) == 1 for c in classes)
    assert [c[0] for c in classes] == sorted(set(strings))


def test_language_id(spark):
    r = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "ber", "ung"], "cc": ["ño", "ción", "que"]}
    data = []
    for i in range(240):
        lang = r.choice(list(syllables))
        text = " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(12))
        data.append((i, text, None if i % 11 == 0 else lang, lang))
    data += [(900, None, "aa", "x"), (901, "12 345 !", "aa", "x"), (902, "", None, None), (None, "kalomi loka", "aa", "x")]
    truth = {d: s for d, _, _, s in data[:240]}
    got = lang_id.language_id(frame(spark, data)).collect()
    assert len(got) == len(data)
    for x in got:
        assert 0 <= x.score <= 1
        if x.doc_id in truth:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
            assert x.lang_pred == truth[x.doc_id]
        elif x.doc_id is not None:
            assert x.lang_pred == "und" and x.score == 0
    assert {x.lang_pred for x in lang_id.language_id(frame(spark, [(1, "abc", None, None)])).collect()} == {"und"}
    assert lang_id.language_id(empty(spark)).count() == 0


def test_language_id_letters_of_all_planes():
    assert not any(chr(i).isalpha() for i in range(lang_id.PLANES, 0x110000))
    for c in ("\U00030000", "\U000323AF", "ſ", "İ"):
        assert lang_id.has_letter(c) == c.isalpha() == bool(len(lang_id.trigrams(lang_id.letters(c))))


def test_language_id_functions_travel_whole(tmp_path):
    """A task must not need the package: its functions run where it is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps((lang_id.letters, lang_id.has_letter, lang_id.trigrams)))
    code = "import pickle; a, b, c = pickle.load(open('f', 'rb')); assert len(c(a('abc'))) == 3 and b('x')"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={})


def _plain_kneser_ney(texts):
    """P(c | a, b) of one language by the textbook sums, and its letters."""
    tri, n2, n1 = Counter(), Counter(), Counter()
    for t in texts:
        s = lang_id.letters(t).tolist()
        tri.update(zip(s, s[1:], s[2:]))
    n2.update(g[1:] for g in tri)
    n1.update(g[1:] for g in n2)

    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one and two else 0.5

    d3, d2, d1 = discount(tri), discount(n2), discount(n1)

    def p(a, b, c, vocabulary):
        low = max(n1[(c,)] - d1, 0) / sum(n1.values()) + max(d1 * len(n1) / sum(n1.values()), 1e-9) / vocabulary
        after = [v for g, v in n2.items() if g[0] == b]
        low = max(n2[(b, c)] - d2, 0) / sum(after) + d2 * len(after) / sum(after) * low if after else low
        after = [v for g, v in tri.items() if g[:2] == (a, b)]
        return max(tri[(a, b, c)] - d3, 0) / sum(after) + d3 * len(after) / sum(after) * low if after else low

    return p, {g[0] for g in n1}


LEARNED = [("x", "abra kadabra"), ("x", "banana band"), ("y", "kraal"), ("y", "zebra zoo ñu"), ("x", "abba"), ("y", "zoo")]


def test_kneser_ney_entropies_against_plain_sums(spark):
    asked = ["abra zebra", "qqq kadan", "zoo", "ñandú ab", "banana", "q"]
    plain = {x: _plain_kneser_ney([t for y, t in LEARNED if y == x]) for x in "xy"}
    vocabulary = len(set().union(*(v for _, v in plain.values()))) + 1
    learned = spark.createDataFrame(LEARNED, "lang string, text string")
    rows_asked = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for cells in (1_000_000, 8, 0):  # all, a few or none of the trigrams in the task
        t, held = lang_id.train(learned, learned.lang, cells)
        assert len(held.keys) <= cells // 2
        got = {x.doc_id: x for x in lang_id.score_rows(rows_asked, t, held).collect()}
        for i, text in enumerate(asked):
            s = lang_id.letters(text).tolist()
            e = {x: -sum(math.log(p(*g, vocabulary)) for g in zip(s, s[1:], s[2:])) / (len(s) - 2) for x, (p, _) in plain.items()}
            assert got[i].lang_pred == min(e, key=e.get)
            assert abs(got[i].entropy - min(e.values())) < 1e-6 and abs(got[i].margin - abs(e["x"] - e["y"])) < 1e-6


def test_kneser_ney_sums_to_one(spark):
    learned = spark.createDataFrame(LEARNED, "lang string, text string")
    t, _ = lang_id.train(learned, learned.lang)
    contexts = [r.key for r in t.by_context.collect()][:10] + [ord("q") << 21 | ord("q")]
    wanted = spark.createDataFrame([((c << 21) | v,) for c in contexts for v in t.last.tolist()], "key long")
    sums = Counter()
    for r in lang_id.log_probabilities(t, wanted).collect():
        for i, x in enumerate(r.logs):
            sums[r.key >> 21, i] += math.exp(x / lang_id.SCALE)
    # One share of the uniform part is for a letter that was never seen.
    assert len(sums) == 2 * len(contexts) and all(0.9 < v <= 1 + 1e-6 for v in sums.values())


def test_language_id_does_not_depend_on_what_tasks_hold(spark):
    data = [(i, t, "en" if i % 2 else "de", s) for i, t, _, s in rows(60) if i is not None] + [(None, "qüx ßß", None, None)] * 2
    one, few = (sorted(lang_id.language_id(frame(spark, data), cells).collect(), key=str) for cells in (4_000_000, 100))
    assert one == few and len(one) == len(data)


def test_url_filter(spark):
    urls = ["https://a.Example.org/es/1", "http://example.org/en/12?x", "https://b.org", "https://x.com/de/3#t", "https://x.com/fr/", "https://x.net/a/",
            "https://www.x.net/a.html?utm_source=f", "no url", None, "", "https://x.net/b", "https://notexample.org/es/1", "https://x.net/a"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.campaign_list(pages)).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.org", "", None, "allow")
    assert got[3][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow")
    assert [got[i][3] for i in (5, 6, 12)] == ["block"] * 3 and got[10][3] == "allow"
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[11][2:] == ("org/", "allow")
    none = spark.createDataFrame([], "url string")
    assert {r.verdict for r in url_filter.url_filter(pages.filter("page_id = 6"), none).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(500).selectExpr("concat('h /', id) url")
    asked = spark.range(2000).selectExpr("concat('h /', id) url")
    hits = {r.url for r in url_filter.possible_hits(asked, listed).collect()}
    assert {f"h /{i}" for i in range(500)} <= hits and len(hits) < 600


CONTROL = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<\\\\|", "a\\nb", "", None, "x" * 5000, "\n\n<|"]


def test_chat_format_round_trip(spark):
    r = random.Random(4)
    turns = [(c, t, r.choice(["user", "assistant", "system", None, "o\\n<|\n"]), r.choice(CONTROL)) for c in range(12) for t in range(r.randrange(1, 6))]
    turns += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (None, None, "assistant", "null keys")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, n string")
    out = chat_format.format_turns(chat_format.canonical_turns(df))
    read = out.select("conv_id", chat_format.read_turns(out.formatted).alias("t"), chat_format.read_loss(out.formatted, out.loss_spans).alias("l")).collect()
    for x in read:
        want = sorted(((t is not None, t or 0, ro or "", tx or "") for c, t, ro, tx in turns if c == x.conv_id))
        assert [(t.role, t.text) for t in x.t] == [(ro, tx) for *_, ro, tx in want]
        assert x.l == [tx for *_, ro, tx in want if ro == "assistant"]
    assert len(read) == 13 and chat_format.digest(chat_format.format_turns(df.limit(0))).count() == 0


def test_layouts(spark):
    records = [{"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o", "id": 3},
               {"messages": [{"role": "human", "content": "h"}, {"role": "gpt", "content": None}]},
               {"conversations": [{"from": "human", "value": "v"}, {"from": "gpt", "value": "w"}]}, {"other": 1}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)] + [(9, "{broken")], "conv_id long, record string")
    got = {}
    for x in chat_format.canonical_turns_json(df).orderBy("conv_id", "turn").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert got == {0: [("user", "p"), ("assistant", "r")], 1: [("user", "i"), ("assistant", "o")], 2: [("user", "h"), ("assistant", None)], 3: [("user", "v"), ("assistant", "w")]}
    assert sorted(x.conv_id for x in chat_format.unknown_layouts(df).collect()) == [4, 9]
    typed = spark.createDataFrame([(1, "q", "a", "extra")], "conv_id long, question string, answer string, role string")
    assert [x.role for x in chat_format.canonical_turns(typed).orderBy("turn").collect()] == ["user", "assistant"]


def test_layouts_leave_out_fields_without_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = [{"conv_id": 1, "prompt": "q", "response": "a"}, {"role": "x", "prompt": "q", "response": "a", "turn": 4}, {"system": "s", "question": "q", "answer": "a"},
               {"messages": [{"role": "assistant", "content": "a", "turn": 2}, {"role": "user", "content": "q", "turn": 1}]},
               {"messages": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}], "text": "t"}, {"role": "user", "text": "q", "turn": 3},
               {"role": None, "text": None}, {"prompt": "q", "answer": "a"}, {"messages": []}]
    want = [two, two, [("system", "s"), *two], two, two, [("user", "q")], [(None, None)], None, None]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "conv_id long, record string")
    got = {}
    for x in chat_format.canonical_turns_json(df).orderBy("conv_id", "turn").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert [got.get(i) for i in range(len(records))] == want
    assert sorted(x.conv_id for x in chat_format.unknown_layouts(df).collect()) == [7, 8]


def test_typed_rows_go_by_their_fingerprint(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, None, None), (1, None, "user", "t")], "conv_id long, turn long, role string, text string")
    assert {tuple(x) for x in chat_format.canonical_turns(df).collect()} == {(1, 0, None, None), (1, None, "user", "t")}
    assert chat_format.canonical_turns(df.select("conv_id", "turn")).count() == 0
    lists = spark.createDataFrame([(1, [("user", "a", 2), ("human", "b", 1)], "t"), (2, [], "t"), (3, None, "t")], "conv_id long, messages array<struct<role string, content string, turn int>>, text string")
    assert [tuple(x) for x in chat_format.canonical_turns(lists).orderBy("turn").collect()] == [(1, 1, "user", "b"), (1, 2, "user", "a")]
    real = chat_format.fingerprint
    monkeypatch.setattr(chat_format, "fingerprint", lambda c: real(F.concat(c, F.uuid())))
    assert chat_format.canonical_turns(df).count() == 0  # nothing but the hash selects a mapping


def test_suffix_dedup_repeated_rows_around_a_copy(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(160))
    data = [(5, passage, "en", "a"), (9, "before " + passage + " after", "en", "a"), (5, passage, "en", "a")]
    got = {(x.doc_id, x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(frame(spark, data).coalesce(1)).collect()}
    assert got == {(5, 0, 0), (9, 160, 1)}


def test_pipeline_near_stage_tells_rows_of_a_doc_id_apart(spark):
    r = random.Random(13)
    words = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(90))
    t, u, v = words(), words(), words()
    data = [(3, t, "en", "a"), (5, t + " tail", "en", "a"), (5, u, "en", "a"), (None, v, "en", "a"), (None, v + " end", "en", "a"), (7, u + " more", "en", "a"), (8, "", "en", "a"), (8, "", "en", "a")]
    got = corpus_pipeline.near(spark, frame(spark, data), "").collect()
    assert sorted((x.doc_id or 0, x.text) for x in got if x.doc_id is not None) == [(3, t), (5, u), (8, "")]
    assert len([x for x in got if x.doc_id is None]) == 1


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    data = [(i, " ".join(f"v{r.randrange(3000)}" for _ in range(r.randrange(60, 200))), "en", r.choice("ab")) for i in range(120)]
    data += [(200 + i, data[i][1] + " ", "en", "a") for i in range(10)] + [(300 + i, data[i][1] + " tail", "en", "b") for i in range(10, 20)]
    data += [(400, "short", "en", "a"), (401, None, None, None), (402, "$$$ " * 90, "en", "b")]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash", "mixing", "packing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, fn in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(fn(spark, docs, str(tmp_path)), name)
        seen[name] = [x.doc_id for x in docs.collect()]
    assert sorted(seen["quality_rules"]) == sorted(d for d, *_ in data if d < 400)
    exact = set(seen["exact_dedup"])
    assert len(exact) == 130 and all((200 + i in exact) != (i in exact) for i in range(10))
    near = set(seen["minhash"])
    assert len(near) == 120 and not near & {300 + i for i in range(10, 20)}
    assert set(seen["mixing"]) <= near and sorted(seen["packing"]) == sorted(seen["mixing"])
    before = set(os.listdir(shared_dir(spark)))
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen["packing"])
    left = set(os.listdir(shared_dir(spark))) - before  # what the last stage read, and its own
    assert sorted(x.split("-")[1] for x in left) == ["lengths", "mixing"]


def test_empty_tables_of_the_large_operators(spark, tmp_path):
    e = empty(spark)
    e.write.parquet(str(tmp_path / "documents.parquet"))
    assert minhash_forest.near_dedup(e).count() == suffix_dedup.suffix_dedup(e).count() == corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(pages, url_filter.campaign_list(pages)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.canonical_turns(turns).count() == 0
