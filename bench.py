"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: total seconds over the headline queries plus seconds
and throughput per query. Each query runs to completion through Spark's
``noop`` sink (every row computed, nothing collected to the driver), after
an untimed warm-up pass on the smallest scale factor (JIT and codegen).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["naive_tokens", "read_requests", "symbols", "skeleton_text", "snapshot_refresh"]
WARMUP_SF = "/root/testdata/sf0.001"


def run(spark, fn, sf_dir: str) -> float:
    t0 = time.time()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    from skimdex.plans.catalog import QUERIES
    from skimdex.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="skimdex-bench")

    if os.path.isdir(WARMUP_SF) and os.environ.get("BENCH_WARMUP", "1") == "1":
        for n in names:
            run(spark, QUERIES[n], WARMUP_SF)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    from pyspark.sql import functions as F

    doc_mb = docs.select(F.sum(F.octet_length("text"))).first()[0] / 1e6
    from skimdex.sources.corpus import code_corpus

    code_mb = code_corpus(spark, sf_dir).select(F.sum("size_bytes")).first()[0] / 1e6
    source_mb = {"naive_tokens": doc_mb, "read_requests": doc_mb, "symbols": code_mb,
                 "skeleton_text": code_mb, "snapshot_refresh": 2 * code_mb}

    secs = {}
    for n in names:
        secs[n] = round(run(spark, QUERIES[n], sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(secs.values()), 3),
        "unit": "sec",
        "queries": secs,
        "source_mb_per_sec": {n: round(source_mb.get(n, 0) / s, 3) for n, s in secs.items() if n in source_mb},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "documents": docs.count(),
        "code_files": part.count(),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
