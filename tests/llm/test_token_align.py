"""Alignment of two tokenizers against a plain version that compares byte ranges."""

import hashlib
import json
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from skimdex.llm import token_align
from skimdex.llm.queries import TOKENIZERS
from tests.llm.helpers import empty, frame, rows

BPE, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(encoders, data):
    a, b = encoders
    chars = token_align.byte_of_char()
    docs, df = [], Counter()
    for d, t, *_ in data:
        sides = []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids
            sides.append([(i, bytes(chars[c] for c in a.id_to_token(i))) for i in ids])
            piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            sides.append([(i, piece(i)) for i in b.encode(t)])
        if not t or any(b"".join(x for _, x in s) != (" " + t).encode() for s in sides):
            docs.append((d, [], [], [], Counter()))
            continue
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append([[i for i, s, e in side if low <= s and e <= cut] for side in spans])
            low = cut
        links, j = Counter(), 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links[i, spans[1][k][0]] += 1
                k += 1
        docs.append((d, *spans, groups, links))
        df.update(links.keys())
    top = defaultdict(int)
    for (i, _), n in df.items():
        top[i] = max(top[i], n)
    out = []
    for d, sa, sb, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        best = sum(n for p, n in links.items() if df[p] == top[p[0]])
        out.append((d, len(sa), len(sb), len(groups), sum(links.values()), best, sum(n * df[p] for p, n in links.items()), sha))
    return out


AWKWARD = [
    (300, "special <|endoftext|> <s> </s> <0x41> <unk>", "en", "a"), (301, "piece mark ▁ inside", "en", "a"), (302, " \n\t ", "en", "a"),
    (303, "日本語のテキスト 😀 é  x", "en", "a"), (304, "\x00\x01 control", "en", "a"), (305, " " * 30_000 + "x", "en", "a"), (306, "a" * 50_000, "en", "a"),
    (307, "ﬁ ligature Ⅷ ½ ™", "en", "a"), (308, "\r\n\r\n  it's we'll", "en", "a"), (309, "﻿mark", "en", "a"),
]


@pytest.mark.parametrize("records,fan_in,share", [(3_000_000, 32, 16 << 20), (500, 3, 2_000)])
def test_against_plain(spark, encoders, monkeypatch, records, fan_in, share):
    monkeypatch.setattr(token_align, "SPILL_RECORDS", records)
    monkeypatch.setattr(token_align, "FAN_IN", fan_in)
    monkeypatch.setattr(token_align, "SHARE_BYTES", share)
    monkeypatch.setattr(token_align, "CHUNK_BYTES", 3_000)
    data = rows() + AWKWARD
    got = token_align.token_align(frame(spark, data), BPE, PIECES).collect()
    assert Counter(map(tuple, got)) == Counter(plain(encoders, data))
    zeros = {r.doc_id for r in got if r.n_a == 0}
    assert {301, 60, 61} <= zeros and 300 not in zeros


def test_merge_of_runs_adds_equal_pairs():
    import numpy as np

    r = np.random.default_rng(4)
    runs = [np.unique(r.integers(0, 5000, 900)) for _ in range(7)]
    pairs, counts = token_align.merged([token_align.sorted_run(x, np.full(len(x), i + 1)) for i, x in enumerate(runs)])
    want = Counter()
    for i, x in enumerate(runs):
        want.update({int(p): i + 1 for p in x})
    assert (np.diff(pairs) > 0).all() and dict(zip(pairs.tolist(), counts.tolist())) == dict(want)


def test_empty_table(spark):
    assert token_align.token_align(empty(spark), BPE, PIECES).collect() == []


def test_ids_out_of_merge_order_are_refused():
    with pytest.raises(ValueError):
        token_align.byte_level_ranks(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "aa": 2}, "merges": ["a b", "a a"]}}))
