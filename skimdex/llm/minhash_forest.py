"""MinHash near-dedup by an LSH forest.

A document's set is its distinct 5-word shingles (64-bit hashes). `TREES` sorted
orders of the documents are made, each by its own `DEPTH` minhash values. A 2-bit
sketch of all values drops pairs that are far from similar.

First, documents that stand beside each other and share a prefix of at least
`LEAST_PREFIX` values are candidates and join into classes. Documents of a class are
sorted next to each other and each block of `BLOCK` is checked pair by pair on whole
sets, skipping pairs that are already connected; what then still crosses blocks is
checked pair by pair too. This connects most of what is linked at little cost.

Then whole runs are compared: all documents that share a prefix of `LEAST_PREFIX`
values in a tree, except pairs that are connected by now. A run is dealt into chunks
and each pair of chunks is one row, so a long run costs the square of its chunks, and
that only while its members stay apart. Pairs whose sketches are close name two
groups of documents, and all pairs of those groups are checked on whole sets.

Links are exact: only recall is a matter of chance. A pair at similarity 0.75 shares
two values in a given tree with probability 0.56 and in none of 16 with 2e-6, however
crowded the region is.

Equal sets are one class from the start, so exact copies cost one row. No group is
gathered: orders are range-partitioned, blocks, chunks and groups are bounded by rows
and by shingles, components are labels in a table.

Defined cases: null text or no word gives an empty set, linked with nothing
(component_id is its doc_id); fewer than five words are one shingle; rows with null
doc_id are linked with nothing and have null component_id; repeated rows are linked;
ties go by doc_id; no rows in, no rows out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import bounded_broadcast, ship, stage
from skimdex.llm.components import components

ship(__name__)
SHINGLE = 5
PERCENT = 75
TREES, DEPTH = 16, 6
VALUES = TREES * DEPTH
LEAST_PREFIX = 2
NEIGHBOURS = 2
#: Share of equal 2-bit values that a candidate needs: 0.81 is expected at
#: similarity 0.75, with a deviation of 0.04; 0.64 is more than four below.
LEAST_EQUAL = 0.64
BLOCK = 128
BLOCK_SHINGLES = 2_000_000
#: Rows of a chunk of a run; rows and shingles of a group that is checked whole. Rows
#: are dealt by hash, so these are means. A document longer than that is a group.
CHUNK = 512
GROUP, GROUP_SHINGLES = 256, 128_000
COLUMNS = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hash of a word, remembered; emptied when it has grown."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a text. bytes.lower() touches A-Z only and
    bytes.split() parts at [\\x20\\x09-\\x0D], as the contract has it."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * ODD + w[k : len(w) - n + 1 + k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    a = r.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], r.integers(0, 1 << 63, VALUES, dtype=np.uint64)[:, None]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """VALUES minhash values of 32 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        least = np.minimum(least, (a * s[None, k : k + 4096] + b).min(axis=1))
    return (least >> np.uint64(32)).astype(">u4")


def two_bits(sig: np.ndarray) -> bytes:
    """The last two bits of each value, 24 bytes."""
    bits = np.unpackbits(sig.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 3:], axis=1)[:, 6:]
    return np.packbits(bits.ravel()).tobytes()


SKETCH = "doc_id long, n_shingles long, set_key binary, sig binary, bits binary"


def _sketch(batches):
    import xxhash

    words, (a, b) = _Words(), _multipliers()
    for batch in batches:
        n, key, sig, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, words)
            n.append(len(s))
            if len(s):
                values = signature(s, a, b)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(values.tobytes())
                bits.append(two_bits(values))
            else:
                key.append(None), sig.append(None), bits.append(None)
        cols = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (key, sig, bits)]]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_key", "sig", "bits"])


def sketches(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_sketch, SKETCH)


def distinct_sets(sk: DataFrame) -> DataFrame:
    """(set_key, rep, n_shingles, sig, bits): one row per set; rep is its least doc_id."""
    return (
        sk.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    )


def tree_orders(sets: DataFrame) -> DataFrame:
    """Every set in each tree, all trees sorted by label over all partitions."""
    label = F.expr(f"substring(sig, tree * {DEPTH * 4} + 1, {DEPTH * 4})")
    rows = sets.select("rep", "sig", "bits", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", label.alias("label"), "rep", "bits")
    return rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


EDGE = "a long, b long, edge boolean, tree int, label binary, bits binary"


def _close(tree, label, bits, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share a tree and a prefix and have similar sketches."""
    same = tree[i] == tree[j]
    same &= (label[i, : 4 * LEAST_PREFIX] == label[j, : 4 * LEAST_PREFIX]).all(axis=1)
    i, j = i[same], j[same]
    differ = bits[i] ^ bits[j]
    differ = (differ | (differ >> 1)) & 0x55
    equal = VALUES - np.unpackbits(differ, axis=1).sum(axis=1)
    same[same] = equal >= LEAST_EQUAL * VALUES
    return same


def _neighbours(batches):
    """Candidate pairs among rows beside each other; the rows at both ends of the
    partition come out too, to be held against the next partition's."""
    held = None
    first = True

    def ends(rows, take):
        tree, label, rep, bits = (x[take] for x in rows)
        n = len(rep)
        return pa.RecordBatch.from_pydict(
            {
                "a": rep, "b": rep, "edge": np.zeros(n, bool), "tree": tree,
                "label": pa.array([x.tobytes() for x in label], pa.binary()), "bits": pa.array([x.tobytes() for x in bits], pa.binary()),
            }
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, label, rep, bits = (batch.column(i) for i in range(4))
        rows = (tree.to_numpy(), _fixed(label, DEPTH * 4), rep.to_numpy(), _fixed(bits, VALUES // 4))
        if first:
            yield ends(rows, slice(0, NEIGHBOURS))
            first = False
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        n, old = len(rows[2]), 0 if held is None else len(held[2])
        for k in range(1, NEIGHBOURS + 1):
            j = np.arange(max(old, k), n)
            i = j - k
            close = _close(rows[0], rows[1], rows[3], i, j)
            a, b = rows[2][i[close]], rows[2][j[close]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "edge": np.ones(len(a), bool), "tree": pa.nulls(len(a), pa.int32()), "label": none, "bits": none})
        held = tuple(x[-NEIGHBOURS:].copy() for x in rows)
    if held is not None:
        yield ends(held, slice(None))


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets that stand beside each other in some tree."""
    found = stage(tree_orders(sets).mapInArrow(_neighbours, EDGE), "neighbours")
    # A few rows for each partition: one task sorts what lies at their borders.
    borders = found.filter("not edge").select("tree", "label", F.col("a").alias("rep"), "bits").distinct().repartition(1).sortWithinPartitions("tree", "label", "rep")
    seams = borders.mapInArrow(_neighbours, EDGE).filter("edge")
    return found.filter("edge").select("a", "b").union(seams.select("a", "b")).filter("a <> b").distinct()


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, of sorted distinct hashes."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s) or 100 * len(s) < PERCENT * len(t):
        return False
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = int((t[at] == s).sum())
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def _block_links(reps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(rep, least rep it is connected to) within a block."""
    root = list(range(len(reps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for j in range(len(reps)):
        for i in range(j):
            ri, rj = find(i), find(j)
            if ri != rj and (reps[i] == reps[j] or linked(sets[i], sets[j])):
                root[rj] = ri
    least: dict[int, int] = {}
    for i, r in enumerate(reps):
        least[find(i)] = min(r, least.get(find(i), r))
    return [(r, least[find(i)]) for i, r in enumerate(reps)]


def _check_blocks(batches):
    """Rows (class, rep, set_key, text) sorted by class: blocks of one class."""
    import xxhash

    words, reps, sets, now, held = _Words(), [], [], None, 0

    def flush():
        links = _block_links(reps, sets)
        return pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in links], pa.int64()), "block_root": pa.array([x[1] for x in links], pa.int64())})

    for batch in batches:
        for cls, rep, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            s = shingles(text, words)
            if xxhash.xxh3_128_digest(s.tobytes()) != key:
                continue  # another row of this doc_id
            if reps and (cls != now or len(reps) >= BLOCK or held + len(s) > BLOCK_SHINGLES):
                yield flush()
                reps, sets, held = [], [], 0
            now = cls
            reps.append(rep)
            sets.append(s)
            held += len(s)
    if reps:
        yield flush()


def _check_pairs(batches):
    words = _Words()
    for batch in batches:
        a, b, s, t = (batch.column(i).to_pylist() for i in range(4))
        ok = [linked(shingles(x, words), shingles(y, words)) for x, y in zip(s, t)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, k in zip(a, ok) if k], pa.int64()), "b": pa.array([x for x, k in zip(b, ok) if k], pa.int64())})


def _texts_of(docs: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """``wanted`` with the text of the document that its column ``on`` names."""
    w = bounded_broadcast(wanted, wanted.count(), 100)
    d = docs.select(F.col("doc_id").alias(on), F.col("text"))
    return d.join(w, on)


def _checked_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked."""
    left = stage(_texts_of(docs, pairs.select("a", "b"), "a").select("a", "b", F.col("text").alias("text_a")), "left")
    both = _texts_of(docs, pairs.select("a", "b"), "b").select("a", "b", F.col("text").alias("text_b"))
    return left.join(both, ["a", "b"]).select("a", "b", "text_a", "text_b").mapInArrow(_check_pairs, "a long, b long")


def verified_links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between linked sets that connect what ``pairs`` suggest;
    ``classes`` are the components of ``pairs``."""
    members = sets.select("set_key", "rep", F.substring("sig", 1, 16).alias("place")).join(classes.withColumnRenamed("node", "rep"), "rep")
    texts = _texts_of(docs, stage(members, "members"), "rep")
    rows = texts.repartitionByRange("root", "place", "rep").sortWithinPartitions("root", "place", "rep").select("root", "rep", "set_key", "text")
    blocks = stage(rows.mapInArrow(_check_blocks, "node long, block_root long").distinct(), "blocks")
    links = blocks.select(F.col("node").alias("a"), F.col("block_root").alias("b"))

    def crossing(of: DataFrame, root: DataFrame) -> DataFrame:
        ra, rb = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return of.join(ra, "a").join(rb, "b").filter("ra <> rb")

    block_roots = blocks.groupBy("node").agg(F.min("block_root").alias("root"))
    left = stage(crossing(pairs, block_roots), "crossing")
    if not left.limit(1).count():
        return links
    # One pair for each two blocks first; then all that are still apart.
    one = left.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    first = stage(_checked_pairs(docs, stage(one, "pairs")), "links")
    links = stage(links.union(first), "links")
    rest = left.select("a", "b").join(one, ["a", "b"], "left_anti")
    apart = stage(crossing(rest, components(links)), "apart")
    return links.union(stage(_checked_pairs(docs, apart), "links")) if apart.limit(1).count() else links


def _apart(xc: np.ndarray, xb: np.ndarray, yc: np.ndarray, yb: np.ndarray):
    """Index pairs of rows of x and y with different components and close sketches."""
    odd = np.uint64(0x5555555555555555)
    order = np.argsort(xc, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(xc[order])) + 1):
        others = np.flatnonzero(yc != xc[rows[0]])
        for k in range(0, len(rows) if len(others) else 0, 64):
            i = rows[k : k + 64]
            differ = xb[i][:, None, :] ^ yb[others][None, :, :]
            differ = (differ | (differ >> np.uint64(1))) & odd
            equal = VALUES - np.bitwise_count(differ).sum(axis=2, dtype=np.int64)
            at, to = np.nonzero(equal >= LEAST_EQUAL * VALUES)
            yield i[at], others[to]


def _short_runs(batches):
    """Rows (held), list of (comp, grp, bits) of a whole run: the same pairs, for all
    runs of a batch at once."""
    odd = np.uint64(0x5555555555555555)
    for batch in batches:
        lists = batch.column(0)
        rows, left = lists.flatten(), np.diff(lists.offsets.to_numpy())
        left = np.repeat(np.cumsum(left), left) - np.arange(len(rows))  # to the run's end
        comp, grp = rows.field("comp").to_numpy(), rows.field("grp").to_numpy()
        bits = _fixed(rows.field("bits"), VALUES // 4).view(np.uint64)
        out, i, k = set(), np.arange(len(rows)), 0
        while len(i := i[left[i] > (k := k + 1)]):
            a = i[comp[i] != comp[i + k]]
            differ = bits[a] ^ bits[a + k]
            differ = (differ | (differ >> np.uint64(1))) & odd
            a = a[VALUES - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) >= LEAST_EQUAL * VALUES]
            out.update(zip(np.minimum(grp[a], grp[a + k]).tolist(), np.maximum(grp[a], grp[a + k]).tolist()))
        x, y = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def _group_pairs(batches):
    """Rows (x, y), lists of (comp, grp, bits) of two chunks of a run: the pairs of
    groups that hold a candidate."""
    for batch in batches:
        out = set()
        for sides in zip(batch.column(0), batch.column(1)):
            (xc, xg, xb), (yc, yg, yb) = (
                (v.field("comp").to_numpy(), v.field("grp").to_numpy(), _fixed(v.field("bits"), VALUES // 4).view(np.uint64)) for v in (side.values for side in sides)
            )
            for i, j in _apart(xc, xb, yc, yb):
                g, h = np.minimum(xg[i], yg[j]), np.maximum(xg[i], yg[j])
                out.update(zip(g.tolist(), h.tolist()))
        x, y = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def run_pairs(sets: DataFrame) -> DataFrame:
    """Distinct pairs (x, y), x <= y, of groups that hold a candidate of a whole run.
    ``sets`` has sig, bits, comp and grp."""
    prefix = F.expr(f"substring(sig, tree * {DEPTH * 4} + 1, {LEAST_PREFIX * 4})")
    rows = sets.select("rep", "comp", "grp", "bits", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", prefix.alias("prefix"), "rep", "comp", "grp", "bits")
    runs = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    runs = stage(runs.filter("least <> most").select("tree", "prefix", F.ceil(F.col("n") / CHUNK).alias("chunks")), "runs")
    members = rows.join(bounded_broadcast(runs, runs.count(), 60), ["tree", "prefix"])
    members = members.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    chunks = stage(
        members.groupBy("tree", "prefix", "chunk").agg(F.first("chunks").alias("chunks"), F.collect_list(F.struct("comp", "grp", "bits")).alias("held")), "chunks"
    )
    pairs = "x long, y long"
    short = stage(chunks.filter("chunks = 1").select("held").mapInArrow(_short_runs, pairs).distinct(), "short_runs")
    many = chunks.filter("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    many = many.groupBy("tree", "prefix", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).agg(
        F.min_by("held", "chunk").alias("x"), F.max_by("held", "chunk").alias("y")
    )
    long = stage(many.select("x", "y").mapInArrow(_group_pairs, pairs).distinct(), "long_runs", 16)
    return short.union(long).distinct()


def _packed(batches):
    """(grp, rep, comp, set_key, text) to (grp, rep, comp, set)."""
    import xxhash

    words = _Words()
    for batch in batches:
        out = []
        for grp, rep, comp, key, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            s = shingles(text, words)
            if xxhash.xxh3_128_digest(s.tobytes()) == key:  # else another row of this doc_id
                out.append((grp, rep, comp, s.tobytes()))
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["grp", "rep", "comp", "set"])


def _all_links(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the linked sets of xs and ys, by counting for all pairs at once
    the hashes that both sides have."""

    def rows(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (xh, xr), (yh, yr) = rows(xs), rows(ys)
    common = np.intersect1d(xh, yh)
    both = np.zeros((len(xs), len(ys)), np.int64)

    def ordered(h, r):
        at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
        keep = common[at] == h if len(common) else np.zeros(len(h), bool)
        order = np.argsort(at[keep], kind="stable")
        return at[keep][order], r[keep][order]

    (xa, xr), (ya, yr) = ordered(xh, xr), ordered(yh, yr)
    for k in range(0, len(common), COLUMNS):
        n = min(COLUMNS, len(common) - k)
        sides = []
        for at, r, size in ((xa, xr, len(xs)), (ya, yr, len(ys))):
            lo, hi = np.searchsorted(at, (k, k + n))
            m = np.zeros((size, n), np.float32)
            m[r[lo:hi], at[lo:hi] - k] = 1
            sides.append(m)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    sizes = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])[None, :]
    return np.nonzero(100 * both >= PERCENT * (sizes - both))


def _check_groups(batches):
    """Rows (x, y), lists of (rep, comp, set) of two groups: edges that connect what
    is linked between them, without those that close a ring."""
    for batch in batches:
        a, b = [], []
        for sides in zip(batch.column(0), batch.column(1)):
            (xr, xc, xs), (yr, yc, ys) = (
                (v.field("rep").to_numpy(), v.field("comp").to_pylist(), [np.frombuffer(s, np.uint64) for s in v.field("set").to_pylist()]) for v in (side.values for side in sides)
            )
            root = {c: c for c in (*xc, *yc)}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i, j in zip(*_all_links(xs, ys)):
                p, q = find(xc[i]), find(yc[j])
                if p != q:
                    root[p] = q
                    a.append(int(xr[i])), b.append(int(yr[j]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def run_links(docs: DataFrame, sets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (a, b) between linked sets that whole runs hold and ``links`` leave
    apart. Members of a class fall to the same groups as far as they fit."""
    classes = classes.select(F.col("node").alias("rep"), F.col("root").alias("cls"))
    comps = components(links).select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    placed = sets.join(classes, "rep", "left").join(comps, "rep", "left")
    placed = stage(placed.select("set_key", "rep", "n_shingles", "sig", "bits", F.coalesce("cls", "rep").alias("cls"), F.coalesce("comp", "rep").alias("comp")), "placed")
    sizes = placed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).filter("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / GROUP, F.col("size") / GROUP_SHINGLES))
    sizes = stage(sizes.select("cls", parts.alias("parts")).filter("parts > 1"), "parts")
    grp = F.xxhash64("cls", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1).cast("long"))))
    placed = stage(placed.join(bounded_broadcast(sizes, sizes.count(), 24), "cls", "left").select("set_key", "rep", "sig", "bits", "comp", grp.alias("grp")), "grouped")
    pairs = stage(run_pairs(placed), "group_pairs")
    if not pairs.limit(1).count():
        return links.limit(0)
    asked = stage(pairs.select(F.col("x").alias("grp")).union(pairs.select("y")).distinct(), "asked")
    members = stage(placed.join(bounded_broadcast(asked, asked.count(), 16), "grp").select("grp", "rep", "comp", "set_key"), "asked_members")
    texts = _texts_of(docs, members, "rep").select("grp", "rep", "comp", "set_key", "text")
    packed = stage(texts.mapInArrow(_packed, "grp long, rep long, comp long, set binary"), "packed")
    groups = stage(packed.groupBy("grp").agg(F.collect_list(F.struct("rep", "comp", "set")).alias("held")), "groups")
    x, y = groups.select(F.col("grp").alias("x"), F.col("held").alias("xs")), groups.select(F.col("grp").alias("y"), F.col("held").alias("ys"))
    both = pairs.join(x, "x").join(y, "y").select("xs", "ys")
    return stage(both.mapInArrow(_check_groups, "a long, b long"), "run_links", 16)


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = stage(sketches(docs), "sketches")
    sets = stage(distinct_sets(sk), "sets")
    pairs = stage(candidates(sets), "candidates")
    classes = components(pairs)
    links = stage(verified_links(docs, sets, pairs, classes), "links")
    roots = components(links.union(run_links(docs, sets, classes, links))).withColumnRenamed("node", "rep")
    of_set = sets.select("set_key", "rep").join(roots, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    return sk.select("doc_id", "n_shingles", "set_key").join(stage(of_set, "classes"), "set_key", "left").select(
        "doc_id",
        "n_shingles",
        "set_key",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
