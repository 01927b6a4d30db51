"""Driver contract and a sample of oracle comparisons at sf0.001."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 45


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"target_dir", "skeleton_tokens", "naive_tokens", "total_session_tokens"} <= set(df.columns)


@pytest.mark.parametrize("name", ["scan_indexable", "read_requests", "coerce_requests", "nearest_package",
                                  "corpus_fingerprint", "snapshot_diff", "export_interfaces", "snapshot_retention"])
def test_oracle_matches(spark, name):
    from oracle_check import compare

    res = compare(spark, SF, [name], verbose=False)[name]
    assert res.get("match"), res
