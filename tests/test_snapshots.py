"""Snapshot store: reuse, change, invalidation, stats (FIXTURES F8-F11)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import make_files
from skimdex.operators import snapshots as SN
from skimdex.operators import symbols as Y
from skimdex.session import scratch_path
from skimdex.streaming import upkeep as SU


def _files(spark, content, mtime_s=0):
    df = make_files(spark, [("sample.ts", content), ("other.ts", "const x = 1;\n")])
    edited = F.lit(dt.datetime(2024, 1, 1, 0, 0, mtime_s))
    return df.withColumn("mtime", F.when(F.col("path") == "sample.ts", edited).otherwise(F.lit(dt.datetime(2024, 1, 1))))


def test_refresh_cycle(spark):
    store = SN.SnapshotStore(spark, scratch_path(spark, "test-store"))
    as_of = F.lit(dt.datetime(2024, 2, 1))
    v1 = _files(spark, "export function a(): void {}\n")
    first = store.refresh(v1, Y.extract_symbols, as_of).first()
    second = store.refresh(v1, Y.extract_symbols, as_of + F.expr("INTERVAL 1 SECOND")).first()
    assert (first.hit, first.layer, first.files_extracted) == (False, "rebuild", 2)
    assert (second.hit, second.layer) == (True, "disk")

    v2 = _files(spark, "export function a(): void {}\nexport function b(): void {}\n", mtime_s=5)
    third = store.refresh(v2, Y.extract_symbols, as_of + F.expr("INTERVAL 2 SECONDS")).first()
    assert (third.hit, third.files_extracted, third.files_reused) == (False, 1, 1)
    assert {r.name for r in store.symbols().collect()} == {"a", "b"}

    stats = store.stats(v2.select("target_dir")).first()
    assert stats.exists and stats.stored_files == 2

    store.invalidate(v2.select("target_dir").distinct(), as_of + F.expr("INTERVAL 3 SECONDS"))
    assert not store.stats(v2.select("target_dir")).first().exists
    after = store.refresh(v2, Y.extract_symbols, as_of + F.expr("INTERVAL 4 SECONDS")).first()
    assert not after.hit


def test_diff_and_fingerprint(spark):
    old = spark.createDataFrame([("/t", "a", 1, 1), ("/t", "b", 2, 2), ("/t", "c", 3, 3)], "target_dir string, path string, size_bytes bigint, mtime_ms bigint")
    new = spark.createDataFrame([("/t", "a", 1, 1), ("/t", "b", 2, 9), ("/t", "d", 4, 4)], "target_dir string, path string, size_bytes bigint, mtime_ms bigint")
    got = {r.path: r.status for r in SN.diff(old, new).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    f_old, f_new = SN.fingerprints(old).first(), SN.fingerprints(old.orderBy(F.desc("path"))).first()
    assert f_old.fingerprint == f_new.fingerprint          # order-independent
    assert SN.fingerprints(new).first().fingerprint != f_old.fingerprint


def test_emptied_target_and_late_edit(spark):
    from skimdex.streaming import upkeep as SU

    store = SN.SnapshotStore(spark, scratch_path(spark, "test-emptied"))
    as_of = F.lit(dt.datetime(2024, 2, 1))
    one = make_files(spark, [("a.ts", "export function a(): void {}\n"), ("b.ts", "export type B = string;\n")], "/t")
    two = make_files(spark, [("u.ts", "export function u(): void {}\n")], "/u")
    both = one.unionByName(two)
    asked = both.select("target_dir")
    store.refresh(both, Y.extract_symbols, as_of, targets=asked)
    status = {r.target_dir: r for r in store.refresh(one, Y.extract_symbols, as_of, targets=asked).collect()}
    assert status["/t"].hit and not status["/u"].hit and status["/u"].files_removed == 1
    assert {r.name for r in store.symbols().collect()} == {"a", "B"}

    schema = "target_dir string, path string, content string, size_bytes bigint, mtime timestamp, deleted boolean"
    day = lambda d: dt.datetime(2024, 1, d)
    SU.apply_changes(store, spark.createDataFrame([("/t", "a.ts", None, None, day(5), True)], schema), Y.extract_symbols, as_of)
    late = ("/t", "a.ts", "export function late(): void {}\n", 32, day(4), False)
    SU.apply_changes(store, spark.createDataFrame([late], schema), Y.extract_symbols, as_of)
    assert {r.name for r in store.symbols().collect()} == {"B"}
    again = ("/t", "a.ts", "export function again(): void {}\n", 33, day(6), False)
    SU.apply_changes(store, spark.createDataFrame([again], schema), Y.extract_symbols, as_of)
    assert {r.name for r in store.symbols().collect()} == {"again", "B"}


def test_fingerprint_moves_with_the_changed_files_alone(spark):
    """The sums of the last event and the changed files give what all files give, and
    the plan reads no other file of the target."""
    import random

    r = random.Random(5)
    stat = lambda: (r.randrange(10**6), r.randrange(10**12))
    old = {(f"/t{i % 3}", f"f{i}.ts"): stat() for i in range(60)}
    new = dict(old)
    changed = []
    for k in r.sample(sorted(old), 25):
        gone = r.random() < 0.3 or k[0] == "/t2" and r.random() < 0.5
        size, mtime = stat()
        changed.append((*k, size, mtime, gone, *old[k]))
        new.pop(k)
        if not gone:
            new[k] = (size, mtime)
    for i in range(5):
        size, mtime = stat()
        changed.append((f"/t{i}", f"new{i}.ts", size, mtime, False, None, None))
        new[f"/t{i}", f"new{i}.ts"] = (size, mtime)
    manifest = "target_dir string, path string, size_bytes long, mtime_ms long"
    rows = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], manifest)
    changes = spark.createDataFrame(changed, manifest + ", deleted boolean, stored_size long, stored_mtime long")
    current = SN.lane_sums(rows(old))
    want = {tuple(x) for x in SN.fingerprints(rows(new)).collect()}
    assert {tuple(x) for x in SN.moved_fingerprints(current, changes).drop("lanes").collect()} == want
    out = [(*k, 1, 1, True, *v) for k, v in old.items()]
    assert SN.moved_fingerprints(current, spark.createDataFrame(out, changes.schema)).count() == 0


def test_streamed_change_keeps_the_fingerprint_of_all_files(spark):
    store = SN.SnapshotStore(spark, scratch_path(spark, "test-lanes"))
    as_of = F.timestamp_seconds(F.lit(1_700_000_000))
    files = make_files(spark, [(f"f{i}.ts", f"export function f{i}() {{}}") for i in range(6)])
    store.refresh(files, Y.extract_symbols, as_of).collect()
    schema = "target_dir string, path string, content string, size_bytes bigint, mtime timestamp, deleted boolean"
    day = dt.datetime(2024, 2, 1)
    text = "export function g() {}"
    batch = [("/t", "f1.ts", text, len(text), day, False), ("/t", "f2.ts", None, None, day, True), ("/t", "n.ts", text, len(text), day, False)]
    SU.apply_changes(store, spark.createDataFrame(batch, schema), Y.extract_symbols, as_of + F.expr("INTERVAL 1 SECOND"))
    stats = store.entries().select("target_dir", "path", *SN.ENTRY_STAT_COLUMNS).distinct()
    event = store.current().first()
    assert (event.n_files, event.fingerprint) == tuple(SN.fingerprints(stats).select("n_files", "fingerprint").first()) and event.n_files == 6
