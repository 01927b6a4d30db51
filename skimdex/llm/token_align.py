"""Cross-tokenizer alignment with external spill counting.

Every text is encoded by two public tokenizers, a byte-level BPE (A) and a
sentence-piece model (B). Both cover the same bytes (a space and the text), so their
tokens can be laid over each other: offsets where a token of each side ends cut a text
into groups, and every A-B pair of occurrences whose byte ranges overlap is a link.
The count of an id pair is the number of rows of the corpus that hold it linked.

* One pass over the texts (Arrow batches) gives the facts of each row and, whenever a
  task holds ``SPILL_RECORDS`` distinct (pair, row) records, spills them: sorted, cut by
  the low bits of the A id into ``BUCKETS`` radix partitions, zstd-compressed, one table
  row for each run and bucket, on the shared folder. Memory of a task is bounded by that
  figure and its longest text.
* A run lists each pair once with its number of rows, so what is counted is combined
  before it moves. Runs of a bucket are counted by k-way heap merges, ``FAN_IN`` runs at
  a time, level by level. A merged run holds a pair at most once, so its size is bounded
  by the two vocabularies, never by the rows; an A id in a third of all rows is one more
  entry in each run. The last level comes in A-major order, which gives the highest
  count of each A id as the merge passes it.
* Contributions stream back: the runs of a bucket, dealt in shares of ``SHARE_BYTES`` (a
  hot bucket has more of them), meet the bucket's counts and leave sums per row; sums of
  a run's rows over its buckets join the facts.

Nothing is capped or sampled and every step is written to the shared folder.

Defined cases: a text that is null or empty, or whose joined token bytes of one side
differ from space + text (U+2581 in the text, for one), has no tokens: zeros and ''. A
null doc_id is kept; rows that share a doc_id, and repeated rows, are rows of their own
and count each. Ties for the highest count of an A id are all highest. Very long texts
are encoded whole and have to fit in a task several times over. An empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import ship, stage

BUCKETS = 64
#: Distinct (pair, row) records a task holds before it spills (16 bytes each).
SPILL_RECORDS = 3_000_000
#: Rows of one run; their sums are held together once.
RUN_ROWS = 1 << 14
FAN_IN = 32
SHARE_BYTES = 16 << 20
#: Bytes of text aligned at a time, and texts in an Arrow batch.
CHUNK_BYTES = 2_000_000
ARROW_TEXTS = 256
SLOT_BITS, PAIR_BITS = 20, 36
LONG_SPACE = 10_000
#: The split of text before merges, of the byte-level tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

FACTS = "run long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUNS = "bucket int, n_pairs long, pairs binary, records binary"
ALIGNED = f"{FACTS}, {RUNS}"

ship(__name__)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    bytes for themselves, the others for the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_ranks(text: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file. Merges are taken by id, so the file
    has to number its merged tokens in the order of its merges (this is checked)."""
    model, table = json.loads(text)["model"], byte_of_char()
    ranks = {bytes(table[c] for c in token): i for token, i in model["vocab"].items() if all(c in table for c in token)}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("ids of merged tokens don't follow the order of the merges")
    return ranks


def piece_bytes(processor) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        else:
            out.append(b"" if processor.is_control(i) or processor.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """The two tokenizers of a task and their byte tables."""

    def __init__(self, byte_bpe: str, piece_model: bytes):
        import numpy as np
        import sentencepiece
        import tiktoken

        ranks = byte_level_ranks(byte_bpe)
        self.file_a, self.whole_a = byte_bpe, None
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        bytes_a, bytes_b = [b""] * (max(ranks.values()) + 1), piece_bytes(self.b)
        for token, i in ranks.items():
            bytes_a[i] = token
        self.bytes = (np.array(bytes_a, object), np.array(bytes_b, object))
        self.size = tuple(np.array([len(x) for x in side], np.int64) for side in (bytes_a, bytes_b))
        self.vocab_b = len(bytes_b)
        most = max(len(bytes_a), len(bytes_b))
        if len(bytes_a) * len(bytes_b) >= 1 << PAIR_BITS:
            raise ValueError("vocabularies are too large for the pair key")
        # "id," "id|" "id;": a token's text in the digest with what follows it.
        self.text = np.array([f"{i}{c}".encode() for c in ",|;" for i in range(most)], object)
        self.most = most

    def encode_a(self, text: str) -> list[int]:
        """By the rank encoder (six times as fast), whose pattern overflows the stack on a
        very long run of white space; such a text goes to the file's own library."""
        if re.search(rf"\s{{{LONG_SPACE}}}", text) is None:
            return self.a.encode_ordinary(text)
        if self.whole_a is None:
            from tokenizers import Tokenizer

            self.whole_a = Tokenizer.from_str(self.file_a)
            self.whole_a.encode_special_tokens = True
        return self.whole_a.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str]):
        """Ids of both sides of each text; none if a side doesn't give its bytes."""
        import numpy as np

        sides = [np.array([], np.int64)] * len(texts), [np.array([], np.int64)] * len(texts)
        for i, (text, ids_b) in enumerate(zip(texts, self.b.encode(texts, num_threads=1))):
            if not text:
                continue
            want = (" " + text).encode()
            ids = [np.array(x, np.int64) for x in (self.encode_a(" " + text), ids_b)]
            if all(b"".join(table[x].tolist()) == want for table, x in zip(self.bytes, ids)):
                sides[0][i], sides[1][i] = ids
        return sides

    def align(self, texts: list[str]):
        """n_a, n_b, n_groups, n_links and digest of each text, and the linked
        (pair, text number) records, distinct, with their number of links."""
        import hashlib

        import numpy as np

        each_a, each_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (each_a, each_b))
        ids_a, ids_b = (np.concatenate([np.array([], np.int64), *side]) for side in (each_a, each_b))
        end_a, end_b = np.cumsum(self.size[0][ids_a]), np.cumsum(self.size[1][ids_b])
        text_end = np.concatenate([[0], end_a])[np.cumsum(n_a)]
        # Every place where a token ends closes a segment that lies in one token of each side.
        mark = np.zeros((end_a[-1] if len(end_a) else 0) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        at = np.flatnonzero(mark)
        in_a, in_b = mark[at] & 1, mark[at] >> 1
        both = in_a & in_b
        of_a, of_b, group = (np.cumsum(x, dtype=np.int64) - x for x in (in_a, in_b, both))
        upto = np.searchsorted(at, text_end, "right")
        n_links = np.diff(upto, prepend=0)
        n_groups = np.diff(np.concatenate([[0], np.cumsum(both, dtype=np.int64)])[upto], prepend=0)

        group_a, group_b = group[in_a > 0], group[in_b > 0]
        total = int(both.sum())
        size_a, size_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        last = lambda g: np.diff(g, append=-1) != 0
        order[np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]] = ids_a + self.most * last(group_a)
        order[np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]] = ids_b + 2 * self.most * last(group_b)
        written, stop = self.text[order].tolist(), np.cumsum(n_a + n_b).tolist()
        digests = [hashlib.sha256(b"".join(written[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *stop], stop)]

        pair = ids_a[of_a] * self.vocab_b + ids_b[of_b]
        keys, links = np.unique(pair << SLOT_BITS | np.repeat(np.arange(len(texts)), n_links), return_counts=True)
        return n_a, n_b, n_groups, n_links, digests, keys, links


def _packed(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _unpacked(blob: bytes):
    """int64 values of a blob."""
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)


def sorted_run(pairs, counts) -> bytes:
    """Ascending pairs (as steps) and their counts."""
    import numpy as np

    return _packed(np.diff(pairs, prepend=0), counts.astype(np.int64))


def read_run(blob: bytes):
    import numpy as np

    both = _unpacked(blob)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def spilled(keys, links, vocab_b: int):
    """(bucket, pairs, packed pairs, packed records) of records (pair, slot)."""
    import numpy as np

    pair = keys >> SLOT_BITS
    bucket = pair // vocab_b % BUCKETS
    order = np.argsort(bucket << (SLOT_BITS + PAIR_BITS) | keys)
    bucket, pair, slot, links = bucket[order], pair[order], (keys & ((1 << SLOT_BITS) - 1))[order], links[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(bucket)]):
        heads = np.flatnonzero(np.diff(pair[i:j], prepend=-1))
        rows = np.diff(heads, append=j - i)
        # Slots and numbers of links as 32-bit values, slots as steps.
        records = _packed(np.diff(slot[i:j], prepend=0).astype(np.int32), links[i:j].astype(np.int32))
        yield int(bucket[i]), len(heads), sorted_run(pair[i:j][heads], rows), records


def read_records(blob: bytes):
    import numpy as np
    import zstandard

    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32)
    return np.cumsum(both[: len(both) // 2], dtype=np.int64), both[len(both) // 2 :].astype(np.int64)


def _align_batches(byte_bpe, piece_model):
    """Arrow batches of (doc_id, text) -> facts and runs."""

    def run_task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = Aligner(byte_bpe.value, piece_model.value)
        run, slot, held, records = TaskContext.get().partitionId() << 24, 0, [], 0
        number, text = pa.int64(), pa.string()
        types = [number, pa.int32(), *[number] * 5, text, pa.int32(), number, pa.binary(), pa.binary()]
        names = ["run", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "bucket", "n_pairs", "pairs", "records"]

        def batch(columns, n):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

        def spill():
            for bucket, n, pairs, blob in spilled(*(np.concatenate(x) for x in zip(*held)), aligner.vocab_b):
                yield batch({"run": [run], "bucket": [bucket], "n_pairs": [n], "pairs": [pairs], "records": [blob]}, 1)

        def chunks(ids, texts):
            begin, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > CHUNK_BYTES or i + 1 == len(texts):
                    yield ids[begin : i + 1], texts[begin : i + 1]
                    begin, size = i + 1, 0

        for b in batches:
            for ids, texts in chunks(b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]):
                n_a, n_b, n_groups, n_links, digests, keys, links = aligner.align(texts)
                facts = {"doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
                yield batch(facts | {"run": [run] * len(ids), "slot": np.arange(slot, slot + len(ids), dtype=np.int32)}, len(ids))
                if len(keys):
                    held.append((keys + slot, links))
                slot, records = slot + len(ids), records + len(keys)
                if records >= SPILL_RECORDS or slot + ARROW_TEXTS > RUN_ROWS:
                    if held:
                        yield from spill()
                    run, slot, held, records = run + 1, 0, [], 0
        if held:
            yield from spill()

    return run_task


def merged(blobs: list[bytes]):
    """k-way heap merge of sorted runs: pairs ascending, counts of equal pairs added."""
    import heapq
    from array import array

    import numpy as np

    runs = [read_run(b) for b in blobs]
    if len(runs) == 1:
        return runs[0]

    def entries(pairs, counts, step=4096):
        for i in range(0, len(pairs), step):
            yield from zip(pairs[i : i + step].tolist(), counts[i : i + step].tolist())

    out, total = array("q"), array("q")
    last = -1
    for pair, count in heapq.merge(*(entries(*r) for r in runs)):
        if pair == last:
            total[-1] += count
        else:
            out.append(pair)
            total.append(count)
            last = pair
    return np.frombuffer(out, np.int64), np.frombuffer(total, np.int64)


def _merge_group(pdf):
    import pandas as pd

    pairs, counts = merged(pdf["pairs"].tolist())
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "n_pairs": [len(pairs)], "pairs": [sorted_run(pairs, counts)]})


def count_pairs(runs: DataFrame) -> DataFrame:
    """(bucket, n_pairs, pairs): one merged run for each bucket."""
    spark = runs.sparkSession
    level = runs.select("bucket", "n_pairs", "pairs", F.xxhash64("run").alias("at"))
    while True:
        most = level.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
        shares = math.ceil(most / FAN_IN)
        dealt = level.withColumn("share", F.pmod("at", F.lit(shares)))
        out = stage(dealt.groupBy("bucket", "share").applyInPandas(_merge_group, "bucket int, n_pairs long, pairs binary"), "merged", codec="none")
        if shares == 1:
            return out
        level = out.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))


def _contributions(vocab_b: int):
    def of_share(runs, counted):
        import numpy as np
        import pandas as pd

        out = []
        if len(runs):
            pairs, counts = read_run(counted["pairs"].iloc[0])
            a = pairs // vocab_b
            heads = np.flatnonzero(np.diff(a, prepend=-1))  # A-major: an A id's pairs are together
            highest = np.repeat(np.maximum.reduceat(counts, heads), np.diff(heads, append=len(a)))
            best = (counts == highest).astype(np.int64)
            for run, own, blob in zip(runs["run"], runs["pairs"], runs["records"]):
                of, rows = read_run(own)
                at = np.repeat(np.searchsorted(pairs, of), rows)
                slot, links = read_records(blob)
                n = int(slot.max()) + 1
                n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, slot, best[at] * links)
                np.add.at(count_sum, slot, counts[at] * links)
                out.append((run, _packed(n_best, count_sum)))
        return pd.DataFrame(out, columns=["run", "sums"])

    return of_share


def _add_up(pdf):
    import numpy as np
    import pandas as pd

    total = np.zeros((2, 0), np.int64)
    for blob in pdf["sums"]:
        own = _unpacked(blob).reshape(2, -1)
        if own.shape[1] > total.shape[1]:
            total = np.pad(total, ((0, 0), (0, own.shape[1] - total.shape[1])))
        total[:, : own.shape[1]] += own
    n = total.shape[1]
    return pd.DataFrame({"run": np.full(n, pdf["run"].iloc[0]), "slot": np.arange(n, dtype=np.int32), "n_best": total[0], "count_sum": total[1]})


def token_align(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row
    of ``docs`` (doc_id, text). ``byte_bpe`` and ``piece_model`` are paths that the driver
    reads; the files' contents (a few MB) travel to the tasks."""
    import sentencepiece

    spark = docs.sparkSession
    with open(byte_bpe, encoding="utf-8") as f:
        bpe = f.read()
    with open(piece_model, "rb") as f:
        model = f.read()
    vocab_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    task = _align_batches(spark.sparkContext.broadcast(bpe), spark.sparkContext.broadcast(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = stage(rows.mapInArrow(task, ALIGNED), "aligned", arrow_rows=ARROW_TEXTS, codec="none")
    facts = aligned.filter("slot is not null").select(*[c.split()[0] for c in FACTS.split(", ")])
    runs = aligned.filter("bucket is not null").select("run", "bucket", "n_pairs", "pairs", "records")

    counted = count_pairs(runs)
    weight = F.sum(F.octet_length("pairs") + F.octet_length("records"))
    shares = runs.groupBy("bucket").agg(F.ceil(weight / SHARE_BYTES).cast("int").alias("shares"))  # BUCKETS rows at most
    dealt = runs.join(F.broadcast(shares), "bucket").withColumn("share", F.pmod(F.xxhash64("run"), "shares").cast("int"))
    copies = counted.join(F.broadcast(shares), "bucket").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    keys = ("bucket", "share")
    left, right = dealt.select(*keys, "run", "pairs", "records").groupBy(*keys), copies.select(*keys, "pairs").groupBy(*keys)
    sums = stage(left.cogroup(right).applyInPandas(_contributions(vocab_b), "run long, sums binary"), "sums", codec="none")
    totals = sums.groupBy("run").applyInPandas(_add_up, "run long, slot int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = facts.join(totals, ["run", "slot"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
