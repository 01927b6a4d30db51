"""Calls of the index tools answered in order, in batch and stream."""

import json
import random

from pyspark.sql import functions as F

from conftest import make_files
from skimdex.operators import index_tools as I
from skimdex.operators import requests
from skimdex.operators import skeleton as K
from skimdex.operators import snapshots as SN
from skimdex.operators import symbols as Y
from skimdex.plans import catalog
from skimdex.session import scratch_path
from skimdex.streaming import index_tools as SI

PAYLOADS = "request_id long, session_id long, payload string"


def call(i, tool, **arguments):
    return (i, 1, json.dumps({"name": tool, "arguments": arguments}))


def replay(rows, state=None):
    """One call after the other: target -> stored."""
    stored, out = dict(state or {}), {}
    for i, _, payload in sorted(rows):
        p = json.loads(payload)
        a, target = p["arguments"], p["arguments"].get("targetDir")
        if not isinstance(target, str) or not target:
            out[i] = "error"
            continue
        target = target.replace("/./", "/")
        before = stored.get(target, False)
        if p["name"] == "repo_index":
            out[i] = ("hit", before and a.get("forceRefresh") is not True)
            stored[target] = True
        elif p["name"] == "index_cache_invalidate":
            out[i] = ("cleared", a.get("clearReadFileCache") is True)
            stored[target] = False
        else:
            out[i] = ("exists", before)
    return out, stored


def seen(rows):
    pick = lambda r: ("hit", r.hit) if r.hit is not None else ("cleared", r.read_file_cache_cleared) if r.index_cache_invalidated else ("exists", r.exists)
    return {r.request_id: "error" if r.error_code else pick(r) for r in rows}


def random_calls(r, n, targets):
    out = []
    for i in range(n):
        tool = r.choice(["repo_index", "repo_index", "index_cache_invalidate", "index_cache_stats"])
        a = {"targetDir": r.choice([*targets, targets[0], targets[0], None, 5, ""])}
        if r.random() < 0.3:
            a["forceRefresh" if tool == "repo_index" else "clearReadFileCache"] = r.choice([True, False, "true", 1])
        out.append(call(i, tool, **a))
    return out


def _targets(spark):
    files = make_files(spark, [("a.ts", "export function f(): void {}\n"), ("b.ts", "const x = 1;\n")], target="/t")
    text = K.skeleton_text(K.skeleton_entries(Y.extract_symbols(files), files))
    return files, I.index_targets(SN.file_manifest(files), K.corpus_totals(text)), text


def test_calls_see_the_calls_before_them(spark):
    files, targets, text = _targets(spark)
    rows = random_calls(random.Random(4), 300, ["/t", "/u/./v", "/w"])
    want, stored = replay(rows)
    answers, state = I.answer(spark.createDataFrame(rows, PAYLOADS), targets, spark.createDataFrame([], I.STATE_SCHEMA))
    got = answers.collect()
    assert seen(got) == want and len(got) == len(rows)
    assert {r.target_dir: r.stored for r in state.collect()} == {t: s for t, s in stored.items()}
    hit = next(r for r in got if r.hit and r.target_dir == "/t")
    assert (hit.layer, hit.files_indexed, hit.fingerprint) == ("disk", 1, SN.fingerprints(SN.file_manifest(files)).first().fingerprint)
    assert hit.skeleton_tokens == round(len(text.first().text) / 4)
    miss = next(r for r in got if r.hit is False and r.target_dir == "/w")
    assert (miss.layer, miss.files_indexed, miss.fingerprint) == ("rebuild", 0, None)


def test_stream_carries_the_state_between_batches(spark):
    _, targets, _ = _targets(spark)
    rows = random_calls(random.Random(9), 120, ["/t", "/u"])
    root = scratch_path(spark, "test-index-tools")
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], PAYLOADS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    for _ in range(2):  # a second run finds nothing new
        SI.start(spark, f"{root}/in", targets, root, max_files_per_trigger=1).awaitTermination()
    assert seen(SI.answers(spark, root).collect()) == replay(rows)[0]
    last = spark.read.parquet(f"{root}/state/batch=2").select("target_dir", "stored").collect()
    assert {r.target_dir: r.stored for r in last} == replay(rows)[1]


def test_no_calls(spark):
    _, targets, _ = _targets(spark)
    answers, state = I.answer(spark.createDataFrame([], PAYLOADS), targets, spark.createDataFrame([("/t", True)], I.STATE_SCHEMA))
    assert answers.collect() == [] and [tuple(r) for r in state.collect()] == [("/t", True)]
    one = I.answer(spark.createDataFrame([call(1, "index_cache_stats", targetDir="/t")], PAYLOADS), targets, state)[0].first()
    assert one.exists is True and one.cache_id == spark.range(1).select(SN.target_id(F.lit("/t"))).first()[0]


def test_one_file_of_calls_is_read_once_by_many_tasks(spark):
    rows = random_calls(random.Random(2), 400, ["/t", "/u"])
    root = scratch_path(spark, "test-index-calls")
    spark.createDataFrame(rows, PAYLOADS).coalesce(1).write.parquet(root)
    payloads = spark.read.parquet(root)
    assert payloads.rdd.getNumPartitions() == 1
    calls, refused = I.index_calls(payloads)
    assert calls.count() + refused.count() == len(rows)
    # Both come from the same files, written by as many tasks as rows are dealt to.
    assert set(calls.inputFiles()) == set(refused.inputFiles()) and len(calls.inputFiles()) > 1
    valid = requests.validate_requests(requests.coerce_requests(payloads)).where("error_code is null and tool = 'repo_index'")
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_the_streamed_thirds_are_dealt_to_many_files(spark, monkeypatch):
    seen_files, start = [], SI.start

    def counted(spark, payload_dir, *a, **b):
        seen_files.append(len(spark.read.parquet(payload_dir).inputFiles()))
        return start(spark, payload_dir, *a, **b)

    monkeypatch.setattr(SI, "start", counted)
    got = catalog.QUERIES["stream_index_tools"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert got.select("request_id").distinct().count() == got.count()
    per_batch = [b - a for a, b in zip([0, *seen_files], seen_files)]
    assert len(per_batch) == 3 and min(per_batch) > 1
