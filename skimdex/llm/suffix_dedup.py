"""Removal of repeated 50-byte strings by sparse suffix sorting.

Every 50-byte window has an anchor: the 16 bytes in it with the least hash, leftmost
first. Equal windows have equal anchors at equal offsets, so only windows whose anchor
occurs in two documents can repeat, and they can be compared anchor by anchor. The
windows of one anchor are a run of neighbouring suffixes, 18 on average, kept as one
context of at most 84 bytes.

1. Texts are packed into chunks, written once as a table bucketed by chunk. Equal texts
   are packed once, with their least doc_id.
2. Chunks send the distinct hashes of their anchors to buckets; a bucket answers with
   one bit for each: does another document have it.
3. Contexts of shared anchors go to their bucket, where the suffixes that start in them
   are sorted: multikey to a shallow depth of 16 bytes, word by word; groups that are
   still together are told apart by their deep bytes, and groups of three or more
   different strings are ordered by a blind trie. Equal suffixes take the least
   doc_id, and each context gets a bit for every window a smaller document has.
4. Bits go back to the chunks, which cut the covered bytes.

Anchors found more than `HOT` times (a line that a third of all documents share) skip
step 3: their windows become rows and take the least doc_id by a map-side combined
aggregate, so no task holds them all. All answers are packed by chunk and bucket.

Defined cases: null text is empty; texts under 50 bytes stay whole; rows with null
doc_id stay whole and are no source for others; rows that repeat a doc_id don't remove
from each other; of equal passages the smallest doc_id's stays; a text of any length is
one row in and out and has to fit a task; no rows in, no rows out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import ARROW_ROWS, CLEANUP, bounded_broadcast, nonnull, partitions, settings, ship, stage
from skimdex.session import scratch_path

ship(__name__)
WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1  # anchors that fit a window, and windows that share one
CHUNK_BYTES = 2 << 20
PART_BYTES = 64 << 20
BLOCK = 1 << 19
BUCKET_ANCHORS = 400_000
HOT = 100_000
SHALLOW = 2  # words of 8 bytes
ROW = 88  # bytes of a padded context
CONTEXTS = 16_384  # contexts that are sorted at once
U = np.uint64


# -- anchors ---------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def _block_anchors(data: np.ndarray, valid: np.ndarray):
    """(hash, anchor, first window, last window) of the runs of valid windows that
    share an anchor; ``data`` has WINDOW - 1 bytes more than ``valid``."""
    h, p, k = data.astype(np.uint64) + U(1), 0x100000001B3, 1
    while k < GRAM:
        h = h[:-k] * U(p) + h[k:]
        p, k = (p * p) & 0xFFFFFFFFFFFFFFFF, 2 * k
    h = _mix(h)
    m, k = h, 1
    while 2 * k <= SPAN:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    m = np.minimum(m[: len(m) - (SPAN - k)], m[SPAN - k :])
    same = np.concatenate(([False], (m[1:] == m[:-1]) & valid[1:] & valid[:-1]))
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.append(same[1:], False))
    out = []
    while len(first):
        at = first + (h[first[:, None] + np.arange(SPAN)] == m[first][:, None]).argmax(axis=1)
        out.append((h[at], at, first, np.minimum(last, at)))
        more = at < last  # an equal hash takes over when this one leaves
        first, last = at[more] + 1, last[more]
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3]


def anchors(blob: np.ndarray, lengths: np.ndarray):
    """(key, document, anchor, first window, last window) of all runs of a chunk, in
    a fixed order; documents don't touch."""
    ends = np.cumsum(lengths)
    parts = []
    for s in range(0, max(0, len(blob) - WINDOW + 1), BLOCK):
        data = blob[s : s + BLOCK + WINDOW - 1]
        p = np.arange(s, s + len(data) - WINDOW + 1)
        valid = p + WINDOW <= ends[np.searchsorted(ends, p, side="right")]
        if valid.any():
            h, *at = _block_anchors(data, valid)
            parts.append([h, *[x + s for x in at]])
    if not parts:
        return [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4]
    h, at, first, last = (np.concatenate(x) for x in zip(*parts))
    # Least hashes are small numbers; mixed again they spread over the buckets.
    return [_mix(h * U(0xD6E8FEB86659FD93)), np.searchsorted(ends, first, side="right"), at, first, last]


def _bucket_ends(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket ends in the sorted keys."""
    return np.searchsorted((keys >> U(32)) * U(n_buckets) >> U(32), np.arange(n_buckets, dtype=np.uint64), side="right")


# -- chunks ----------------------------------------------------------------

CHUNK = "chunk long, ids binary, shas binary, lengths binary, blob binary"


def _pack_chunks(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, shas, texts, held = [], [], [], 0

    def row():
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([number], pa.int64()),
                "ids": [np.array(ids, np.int64).tobytes()],
                "shas": [b"".join(shas)],
                "lengths": [np.array([len(t) for t in texts], np.int64).tobytes()],
                "blob": pa.array([b"".join(texts)], pa.binary()),
            }
        )

    for batch in batches:
        for doc, sha, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids.append(doc)
            shas.append(bytes.fromhex(sha))
            texts.append(text)
            held += len(text)
            if held >= CHUNK_BYTES:
                yield row()
                number += 1
                ids, shas, texts, held = [], [], [], 0
    if ids:
        yield row()


class _Chunk:
    def __init__(self, ids: bytes, shas: bytes, lengths: bytes, blob: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.shas = [shas[i : i + 32].hex() for i in range(0, len(shas), 32)]
        self.lengths = np.frombuffer(lengths, np.int64)
        self.blob = np.frombuffer(blob, np.uint8)
        self.key, self.doc, self.at, self.first, self.last = anchors(self.blob, self.lengths)


def _chunks(batch):
    """(chunk number, chunk, further columns) of each row."""
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        yield row[0], _Chunk(*row[1:5]), row[5:]


def _distinct(chunk: _Chunk):
    """Sorted distinct keys, and the place of each anchor's key among them."""
    return np.unique(chunk.key, return_inverse=True)


# -- which anchors are shared ----------------------------------------------


def _send_keys(n_buckets: int):
    def run(batches):
        for batch in batches:
            for number, c, _ in _chunks(batch):
                keys, place = _distinct(c)
                low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
                np.minimum.at(low, place, c.ids[c.doc])
                np.maximum.at(high, place, c.ids[c.doc])
                many = np.ceil(np.log2(np.bincount(place, minlength=len(keys)) + 1)).astype(np.uint8)
                note = many | np.where(low != high, 128, 0).astype(np.uint8)
                end = _bucket_ends(keys, n_buckets)
                start = np.append(0, end[:-1])
                some = np.flatnonzero(end > start)
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(some, pa.int64()),
                        "chunk": pa.array(np.full(len(some), number), pa.int64()),
                        "keys": pa.array([keys[start[i] : end[i]].tobytes() for i in some], pa.binary()),
                        "notes": pa.array([note[start[i] : end[i]].tobytes() for i in some], pa.binary()),
                    }
                )

    return run


def _find_shared(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
        note = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["notes"]])
        _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        shared = n > 1
        shared[place[note >= 128]] = True
        times = np.bincount(place, weights=2.0 ** (note & 127), minlength=len(n))
        kind = np.where(shared, np.where(times > 2 * hot, 2, 1), 0).astype(np.uint8)[place]
        ends = np.cumsum([len(x) // 8 for x in rows["keys"]])
        parts = np.split(kind, ends[:-1])
        return pd.DataFrame(
            {
                "chunk": rows["chunk"],
                "bucket": rows["bucket"],
                "shared": [np.packbits(x == 1).tobytes() for x in parts],
                "hot": [np.packbits(x == 2).tobytes() if (x == 2).any() else None for x in parts],
            }
        )

    return run


def _stored_chunks(chunks: DataFrame, n_parts: int) -> DataFrame:
    """Chunks as a table bucketed by their number: what is joined to them later is
    dealt to their buckets, and the texts are never dealt again."""
    spark = chunks.sparkSession
    path = scratch_path(spark, "chunks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with settings(spark, {ARROW_ROWS: "2000", CLEANUP: "true"}):
        writer = chunks.repartition(n_parts, "chunk").write.bucketBy(n_parts, "chunk")
        writer.option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def _by_chunk(chunks: DataFrame, rows: DataFrame, n_parts: int, **arrays: tuple[str, ...]) -> DataFrame:
    """Chunks with the answers of all buckets, as the named arrays."""
    packed = rows.repartition(n_parts, "chunk").groupBy("chunk")
    packed = packed.agg(*[F.array_sort(F.collect_list(F.when(F.col(c[0]).isNotNull(), F.struct(*c)))).alias(k) for k, c in arrays.items()])
    return chunks.join(packed.hint("shuffle_hash"), "chunk", "left")


def _kinds(c: _Chunk, n_buckets: int, answers) -> np.ndarray:
    """For each anchor of the chunk: 0 of one document only, 1 shared, 2 hot."""
    keys, place = _distinct(c)
    end = _bucket_ends(keys, n_buckets)
    start = np.append(0, end[:-1])
    kind = np.zeros(len(keys), np.uint8)
    for a in answers or ():
        s, e = start[a["bucket"]], end[a["bucket"]]
        bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), count=e - s)  # noqa: E731, B023
        kind[s:e] = bits(a["shared"])
        if a["hot"] is not None:
            kind[s:e] |= bits(a["hot"]) << 1
    return kind[place]


# -- contexts and their suffixes -------------------------------------------

CONTEXT = "bucket long, chunk long, rec binary, keys binary, docs binary, shape binary, text binary"


def _send_contexts(n_buckets: int):
    def run(batches):
        for batch in batches:
            for number, c, (answers,) in _chunks(batch):
                rec = np.flatnonzero(_kinds(c, n_buckets, answers) == 1)
                rec = rec[np.argsort(c.key[rec], kind="stable")]
                if not len(rec):
                    continue
                end = _bucket_ends(c.key[rec], n_buckets)
                start = np.append(0, end[:-1])
                some = np.flatnonzero(end > start)
                shape = np.stack([c.at[rec] - c.last[rec], c.last[rec] - c.first[rec] + 1], axis=1).astype(np.uint8)
                size = shape[:, 1].astype(np.int64) + WINDOW - 1
                upto = np.cumsum(size)
                flat = np.repeat(c.first[rec] - (upto - size), size) + np.arange(upto[-1])
                text = c.blob[flat]
                text_at = lambda i: 0 if i == 0 else int(upto[i - 1])  # noqa: E731, B023
                cut = lambda x: pa.array([x[start[i] : end[i]].tobytes() for i in some], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(some, pa.int64()),
                        "chunk": pa.array(np.full(len(some), number), pa.int64()),
                        "rec": cut(rec.astype(np.uint32)),
                        "keys": cut(c.key[rec]),
                        "docs": cut(c.ids[c.doc[rec]]),
                        "shape": cut(shape),
                        "text": pa.array([text[text_at(start[i]) : text_at(end[i])].tobytes() for i in some], pa.binary()),
                    }
                )

    return run


def _padded(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), ROW), np.uint8)
    upto = np.cumsum(size)
    for s in range(0, len(size), 65_536):
        n = size[s : s + 65_536]
        base = int(upto[s] - size[s])
        row = np.repeat(np.arange(s, s + len(n)), n)
        col = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[row, col] = text[base : base + int(n.sum())]
    return out


class BlindTrie:
    """Orders strings of one length: inner nodes keep the place at which their
    branches part, leaves the strings. A string goes down blindly by the bytes at
    those places, is compared with the leaf it meets, and is hung in where they
    differ."""

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, item) -> None:
        if self.root is None:
            self.root = [s, [item]]
            return
        node = self.root
        while isinstance(node, dict):
            node = node["next"].get(s[node["at"]]) or next(iter(node["next"].values()))
        other = node[0]
        part = next((i for i in range(len(s)) if s[i] != other[i]), None)
        if part is None:
            node[1].append(item)
            return
        above, step, node = None, None, self.root
        while isinstance(node, dict) and node["at"] < part:
            above, step, node = node, s[node["at"]], node["next"][s[node["at"]]]
        leaf = [s, [item]]
        if isinstance(node, dict) and node["at"] == part:
            node["next"][s[part]] = leaf
            return
        new = {"at": part, "next": {other[part]: node, s[part]: leaf}}
        if above is None:
            self.root = new
        else:
            above["next"][step] = new

    def classes(self):
        """Lists of the items of equal strings, in the order of the strings."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                todo += [node["next"][k] for k in sorted(node["next"], reverse=True)]
            else:
                yield node[1]


def _words(rows: np.ndarray) -> np.ndarray:
    """Words of 8 bytes that start at byte 8 * j + s of each row: [row, s, j]."""
    wide = np.zeros((len(rows), ROW + 8), np.uint8)
    wide[:, :ROW] = rows
    return np.stack([np.ascontiguousarray(wide[:, s : s + ROW]).view(">u8").astype(np.uint64) for s in range(8)], axis=1)


def suffix_classes(rows: np.ndarray, group: np.ndarray, count: np.ndarray, right: np.ndarray):
    """Classes of equal suffixes of 50 bytes among those that start at the first
    ``count`` places of each row. Suffixes are compared within a group at the same
    distance to the anchor (``right`` - place). Returns (row, place, class)."""
    row = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    words, s, j = _words(rows), place % 8, place // 8
    key = group[row] * 64 + (right[row] - place)
    shallow = [words[row, s, j + k] for k in range(SHALLOW)]
    order = np.lexsort((*reversed(shallow), key))  # multikey, to the shallow depth
    differs = np.zeros(len(order), bool)
    differs[:1] = True
    for x in (key, *shallow):
        differs[1:] |= x[order[1:]] != x[order[:-1]]
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(differs) - 1
    n_classes = int(differs.sum())
    whole = WINDOW // 8
    deep = [words[row, s, j + k] for k in range(SHALLOW, whole)] + [words[row, s, j + whole] >> U(64 - 8 * (WINDOW - 8 * whole))]
    # Groups that are still together: those of one or two strings need no trie.
    for _ in range(2):
        open_ = np.flatnonzero(np.bincount(cls, minlength=n_classes)[cls] > 1)
        if not len(open_):
            return row, place, cls
        _, lead_at, of = np.unique(cls[open_], return_index=True, return_inverse=True)
        lead = open_[lead_at][of]
        other = np.zeros(len(open_), bool)
        for d in deep:
            other |= d[open_] != d[lead]
        apart = open_[other]
        if not len(apart):
            return row, place, cls
        _, new = np.unique(cls[apart], return_inverse=True)
        cls[apart] = n_classes + new
        n_classes += int(new.max()) + 1
        settled = apart
    # What parted last may still hold different strings.
    _, lead_at, of = np.unique(cls[settled], return_index=True, return_inverse=True)
    mixed = np.zeros(len(settled), bool)
    for d in deep:
        mixed |= d[settled] != d[settled[lead_at][of]]
    bad = np.unique(cls[settled][mixed])
    todo = settled[np.isin(cls[settled], bad)]
    tries: dict[int, BlindTrie] = {}
    for i in todo:
        at = place[i] + 8 * SHALLOW
        tries.setdefault(int(cls[i]), BlindTrie()).insert(rows[row[i], at : place[i] + WINDOW].tobytes(), i)
    for trie in tries.values():
        for items in trie.classes():
            cls[items] = n_classes
            n_classes += 1
    return row, place, cls


def repeated_windows(keys: np.ndarray, docs: np.ndarray, shape: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A bit for each window of each context: a smaller document has it."""
    left, count = shape[:, 0].astype(np.int64), shape[:, 1].astype(np.int64)
    rows = _padded(text, count + WINDOW - 1)
    h = keys * U(31) + left.astype(np.uint64) * U(64) + count.astype(np.uint64)
    for w in rows.view(np.uint64).T:
        h = _mix(h ^ w)
    order = np.lexsort((h, keys))
    keys, docs, left, count, rows, h = (x[order] for x in (keys, docs, left, count, rows, h))
    new = np.ones(len(keys), bool)  # equal contexts stand beside each other
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(axis=1) | (keys[1:] != keys[:-1]) | (left[1:] != left[:-1]) | (count[1:] != count[:-1])
    context = np.cumsum(new) - 1
    one = np.flatnonzero(new)
    least = np.minimum.reduceat(docs, one)
    new_key = np.append(True, keys[one][1:] != keys[one][:-1])
    group = np.cumsum(new_key) - 1
    group_start = np.append(np.flatnonzero(new_key), len(one))
    masks = np.zeros(len(keys), np.uint64)
    at = 0
    while at < len(group_start) - 1:  # whole groups, up to CONTEXTS at once
        upto = max(at + 1, int(np.searchsorted(group_start, group_start[at] + CONTEXTS, side="right")) - 1)
        a, b = group_start[at], group_start[upto]
        min_doc = np.repeat(least[a:b, None], SPAN, axis=1)
        crowd = np.flatnonzero(np.bincount(group[a:b] - at)[group[a:b] - at] > 1)
        if len(crowd):
            k = one[a:b][crowd]
            row, place, cls = suffix_classes(rows[k], group[a:b][crowd] - at, count[k], left[k] + count[k] - 1)
            doc_of = least[a:b][crowd][row]
            by = np.lexsort((doc_of, cls))
            starts = np.flatnonzero(np.append(True, cls[by][1:] != cls[by][:-1]))
            low = np.empty(len(cls), np.int64)
            low[by] = np.repeat(doc_of[by][starts], np.diff(np.append(starts, len(by))))
            min_doc[crowd[row], place] = low
        s, e = one[a], one[b] if b < len(one) else len(keys)
        hit = min_doc[context[s:e] - a] < docs[s:e, None]
        hit &= np.arange(SPAN) < count[s:e, None]
        masks[s:e] = (hit.astype(np.uint64) << np.arange(SPAN, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        at = upto
    out = np.empty_like(masks)
    out[order] = masks
    return out


def _sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
    masks = repeated_windows(join("keys", np.uint64), join("docs", np.int64), join("shape", np.uint8).reshape(-1, 2), join("text", np.uint8))
    parts = np.split(masks, np.cumsum([len(x) // 4 for x in rows["rec"]])[:-1])
    rec = [np.frombuffer(x, np.uint32) for x in rows["rec"]]
    return pd.DataFrame(
        {"chunk": rows["chunk"], "bucket": rows["bucket"], "rec": [r[m > 0].tobytes() for r, m in zip(rec, parts)], "masks": [m[m > 0].tobytes() for m in parts]}
    )


def _hot_windows(n_buckets: int):
    """The windows of hot anchors as rows."""

    def run(batches):
        for batch in batches:
            for number, c, (answers,) in _chunks(batch):
                rec = np.flatnonzero(_kinds(c, n_buckets, answers) == 2)
                for r in rec:
                    n = int(c.last[r] - c.first[r]) + 1
                    p = int(c.first[r])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "chunk": pa.array([number] * n, pa.int64()),
                            "rec": pa.array([int(r)] * n, pa.int64()),
                            "place": pa.array(range(n), pa.int32()),
                            "doc": pa.array([int(c.ids[c.doc[r]])] * n, pa.int64()),
                            "window": pa.array([c.blob[p + i : p + i + WINDOW].tobytes() for i in range(n)], pa.binary()),
                        }
                    )

    return run


def _hot_answers(chunks: DataFrame, n_buckets: int) -> DataFrame:
    rows = stage(chunks.mapInArrow(_hot_windows(n_buckets), "chunk long, rec long, place int, doc long, window binary"), "hot", 4)
    # Written, so that the join deals both sides itself and Spark can split a hot key.
    least = stage(rows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most"), "least")
    hit = rows.join(least, "window").filter("least < doc")
    return hit.groupBy("chunk", "rec").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))


# -- cutting ---------------------------------------------------------------

RESULT = "sha string, doc_id long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    for batch in batches:
        for _, c, (answers, hot) in _chunks(batch):
            covered = np.zeros(len(c.blob) + 1, np.int32)
            recs = [np.frombuffer(a["rec"], np.uint32).astype(np.int64) for a in answers or ()]
            masks = [np.frombuffer(a["masks"], np.uint64) for a in answers or ()]
            if hot:
                recs.append(np.array([x["hot_rec"] for x in hot], np.int64))
                masks.append(np.array([x["hot_mask"] for x in hot], np.int64).astype(np.uint64))
            if recs:
                rec, mask = np.concatenate(recs), np.concatenate(masks)
                for i in range(SPAN):
                    p = c.first[rec[(mask >> U(i)) & U(1) == 1]] + i
                    np.add.at(covered, p, 1)
                    np.add.at(covered, p + WINDOW, -1)
            gone = np.cumsum(covered[:-1]) > 0
            ends = np.cumsum(c.lengths)
            out = []
            for doc, sha, s, e in zip(c.ids, c.shas, ends - c.lengths, ends):
                g = gone[s:e]
                if not g.any():
                    out.append((sha, int(doc), 0, 0, sha))
                    continue
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                out.append((sha, int(doc), int(g.sum()), spans, hashlib.sha256(c.blob[s:e][~g].tobytes()).hexdigest()))
            sha, doc, removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_pydict({"sha": sha, "doc_id": doc, "n_removed": removed, "n_spans": spans, "kept_sha256": kept})


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    spark = docs.sparkSession
    data = F.to_binary(nonnull("text"), F.lit("utf-8"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    d = d.withColumns({"sha": F.sha2("data", 256), "n_bytes": F.octet_length("data").cast("long")})
    rows = stage(d.select("doc_id", "sha", "n_bytes"), "texts")
    total = rows.select(F.sum("n_bytes")).first()[0] or 0
    least = stage(rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least")), "least")
    copies = stage(rows.join(least, "sha").filter("doc_id <> least").select("doc_id", "sha").distinct(), "copies")
    n_buckets = max(partitions(spark), int(total // 18 // BUCKET_ANCHORS) + 1)
    unlike = d.filter("doc_id is not null").join(bounded_broadcast(copies, copies.count(), 160), ["doc_id", "sha"], "left_anti")
    n_parts = max(partitions(spark), int(total // PART_BYTES) + 1)
    chunks = _stored_chunks(unlike.select("doc_id", "sha", "data").mapInArrow(_pack_chunks, CHUNK), n_parts)

    shared = chunks.mapInArrow(_send_keys(n_buckets), "bucket long, chunk long, keys binary, notes binary")
    shared = stage(shared.groupBy("bucket").applyInPandas(_find_shared(hot), "chunk long, bucket long, shared binary, hot binary"), "shared", 4)
    marked = _by_chunk(chunks, shared, n_parts, answers=("bucket", "shared", "hot"))
    masks = marked.mapInArrow(_send_contexts(n_buckets), CONTEXT).groupBy("bucket").applyInPandas(_sort_bucket, "chunk long, bucket long, rec binary, masks binary")
    masks = stage(masks.filter(F.octet_length("rec") > 0), "masks", 4)
    none = F.lit(None).cast("long")
    found = masks.select("chunk", "bucket", "rec", "masks", none.alias("hot_rec"), none.alias("hot_mask"))
    if shared.filter("hot is not null").limit(1).count():
        hot_masks = stage(_hot_answers(marked, n_buckets), "hotmasks", 4)
        found = found.unionByName(hot_masks.select("chunk", F.col("rec").alias("hot_rec"), F.col("mask").alias("hot_mask")), allowMissingColumns=True)
    answered = _by_chunk(chunks, found, n_parts, answers=("bucket", "rec", "masks"), hot=("hot_rec", "hot_mask"))
    cut = stage(answered.mapInArrow(_cut, RESULT).withColumnRenamed("doc_id", "source").dropDuplicates(["sha"]), "cut", 4)

    whole = (F.col("doc_id") > F.col("source")) & (F.col("n_bytes") >= WINDOW)  # a copy of a smaller document
    same = F.col("doc_id") == F.col("source")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(cut, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(same, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(same, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, empty).when(same, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
