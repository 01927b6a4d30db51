"""Streams equal their batch twins; late changes are ignored; the budget log
reads records of both shapes (FIXTURES F8-F10 in streaming form)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import make_files
from skimdex.operators import snapshots as SN
from skimdex.operators import symbols as Y
from skimdex.session import scratch_path
from skimdex.sources import budget_log as BL
from skimdex.streaming import reads as SR
from skimdex.streaming import upkeep as SU


def test_read_stream_equals_batch(spark):
    files = make_files(spark, [("a.ts", "l1\nl2\nl3\n"), ("b.ts", "x")])
    payloads = spark.createDataFrame(
        [(1, 7, '{"name": "read_file", "arguments": {"path": "a.ts", "baseDir": "/t", "maxLines": 2}}'),
         (2, 7, '{"name": "read_file", "arguments": {"path": "missing.ts", "baseDir": "/t"}}'),
         (3, 8, '{"name": "nope", "arguments": {}}'),
         (4, 8, "{bad")],
        "request_id bigint, session_id bigint, payload string",
    )
    base = scratch_path(spark, "test-stream")
    payloads.repartition(2).write.parquet(f"{base}/in")
    SR.start(spark, f"{base}/in", files, f"{base}/out", f"{base}/chk", max_files_per_trigger=1).awaitTermination()
    streamed = {r.request_id: r.asDict() for r in spark.read.parquet(f"{base}/out").collect()}
    batch = {r.request_id: r.asDict() for r in SR.answer(payloads, files).collect()}
    assert streamed == batch
    assert streamed[1]["mode"] == "capped" and streamed[2]["error"].startswith("File not found")
    assert streamed[3]["error_code"] == -32601 and streamed[4]["error_code"] == -32700


def test_upkeep_stream(spark):
    t0 = dt.datetime(2024, 1, 1)
    v1 = make_files(spark, [("a.ts", "export function a(): void {}\n"), ("b.ts", "export enum B { X }\n")])
    v1 = v1.withColumn("mtime", F.lit(t0))
    store = SN.SnapshotStore(spark, scratch_path(spark, "test-upkeep-store"))
    as_of = F.lit(dt.datetime(2024, 2, 1))
    store.refresh(v1, Y.extract_symbols, as_of).collect()
    schema = "target_dir string, path string, content string, size_bytes bigint, mtime timestamp, deleted boolean"
    later, older = dt.datetime(2024, 1, 2), dt.datetime(2023, 12, 1)
    changes = spark.createDataFrame(
        [("/t", "a.ts", "export function a2(): void {}\n", 31, later, False),
         ("/t", "a.ts", "export function stale(): void {}\n", 34, older, False),
         ("/t", "b.ts", None, None, later, True),
         ("/t", "c.ts", "export type C = string;\n", 24, later, False)],
        schema,
    )
    base = scratch_path(spark, "test-upkeep")
    changes.coalesce(1).write.parquet(f"{base}/in")
    SU.start(spark, f"{base}/in", store, Y.extract_symbols, f"{base}/chk", as_of).awaitTermination()
    got = {(r.path, r.name) for r in store.symbols().collect()}
    assert got == {("a.ts", "a2"), ("c.ts", "C")}
    # a change older than the stored stat is ignored
    stale = spark.createDataFrame([("/t", "a.ts", "export function old(): void {}\n", 31, older, False)], schema)
    SU.apply_changes(store, stale, Y.extract_symbols, as_of + F.expr("INTERVAL 1 HOUR"))
    assert {(r.path, r.name) for r in store.symbols().collect()} == got
    # deleting every file of the target removes its snapshot
    gone = spark.createDataFrame([("/t", p, None, None, later + dt.timedelta(days=1), True) for p in ("a.ts", "c.ts")], schema)
    SU.apply_changes(store, gone, Y.extract_symbols, as_of + F.expr("INTERVAL 2 HOURS"))
    assert not store.stats(gone.select("target_dir")).first().exists


def test_budget_log_shapes(spark):
    log = scratch_path(spark, "test-log")
    rows = spark.createDataFrame(
        [("/t", 2, 385, 3986, 2953, 2, 2568)],
        "target_dir string, files_indexed bigint, skeleton_tokens bigint, naive_tokens bigint, "
        "total_session_tokens bigint, files_read_on_demand bigint, file_tokens bigint",
    )
    ts = F.lit(dt.datetime(2024, 3, 17, 19, 25, 39))
    BL.append_log(BL.log_records(rows, ts, BL.MODE_MOCK), log)
    cache = spark.createDataFrame([("/t", True, "abc")], "target_dir string, hit boolean, target_id string")
    BL.append_log(BL.log_records(rows, ts, BL.MODE_MOCK, cache=cache), log)
    got = sorted(BL.read_log(spark, log).collect(), key=lambda r: r.index_cache_hit is None)
    assert got[0].index_cache_hit is True and got[0].index_cache_file == "abc.json"
    assert got[1].index_cache_enabled is None and got[1].naive_tokens == 3986


def test_read_stream_parses_requested_files(spark):
    from skimdex.operators import skeleton as K

    files = make_files(spark, [("a.ts", "export function f(n: number): void {}\n"), ("b.ts", "export function g(): void {}\n")])
    call = '{"name": "read_file", "arguments": {"path": "%s", "baseDir": "/t"%s}}'
    payloads = spark.createDataFrame(
        [(1, 7, call % ("a.ts", ', "symbolsOnly": true')), (2, 7, call % ("b.ts", "")), (3, 7, call % ("../x.ts", ', "symbolsOnly": true'))],
        "request_id bigint, session_id bigint, payload string",
    )
    base = scratch_path(spark, "test-stream-symbols")
    payloads.write.parquet(f"{base}/in")
    SR.start(spark, f"{base}/in", files, f"{base}/out", f"{base}/chk", symbols_for=K.symbols_bodies).awaitTermination()
    got = {r.request_id: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert got[1].content == "// symbols-only mode: a.ts\nexport function f(n: number): void"
    assert got[2].mode == "full" and got[3].error.startswith("Path escapes baseDir")
