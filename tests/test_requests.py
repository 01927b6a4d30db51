"""Tool-call argument coercion and validation (FIXTURES E8)."""

from skimdex.operators import requests as Q


def test_coercion_and_validation(spark):
    payloads = [
        (1, '{"name": "read_file", "arguments": {"path": "a.ts", "baseDir": "/t", "maxLines": "3"}}'),
        (2, '{"name": "read_file", "arguments": {"path": "a.ts", "baseDir": "/t", "lineRange": [2]}}'),
        (3, '{bad'),
        (4, '{"name": "write_file", "arguments": {}}'),
        (5, '{"name": "read_file", "arguments": {"path": "a.ts"}}'),
        (6, '{"name": "read_file", "arguments": {"path": "a.ts", "baseDir": "/t", "maxLines": 3, "lineRange": [2, 4], "symbolsOnly": true}}'),
        (7, '{"arguments": {}}'),
    ]
    df = spark.createDataFrame(payloads, "request_id bigint, payload string")
    r = {x.request_id: x for x in Q.validate_requests(Q.coerce_requests(df)).collect()}
    assert r[1].max_lines is None and r[1].error_code is None
    assert r[2].line_start is None and r[2].line_end is None
    assert not r[3].valid_json and r[3].error_code == -32700
    assert r[4].error_code == -32601 and r[4].error == "Unknown tool: write_file"
    assert r[5].error_code == -32602 and r[5].error == "read_file requires path and baseDir"
    assert (r[6].max_lines, r[6].line_start, r[6].line_end, r[6].symbols_only) == (3, 2, 4, True)
    assert r[7].error == "Missing tool name"


def test_all_tools_and_large_numbers(spark):
    import json

    from skimdex.operators import requests as Q

    calls = [("read_file", {"path": "a", "baseDir": "/r", "maxLines": 9007199254740991, "lineRange": [1, 9999999999]}), ("repo_index", {"targetDir": "/r", "forceRefresh": True}),
             ("index_cache_invalidate", {}), ("index_cache_stats", {"targetDir": 3}), ("repo_index", {"targetDir": ""}), ("other", {})]
    df = spark.createDataFrame([(i, json.dumps({"name": n, "arguments": a})) for i, (n, a) in enumerate(calls)], "request_id long, payload string")
    got = {r.request_id: r for r in Q.validate_requests(Q.coerce_requests(df)).collect()}
    assert (got[0].max_lines, got[0].line_start, got[0].line_end, got[0].error) == (2**31 - 1, 1, 2**31 - 1, None)
    assert got[1].error is None and got[1].force_refresh and got[1].target_dir == "/r"
    assert [got[i].error for i in (2, 3, 4)] == [f"{n} requires targetDir" for n in ("index_cache_invalidate", "index_cache_stats", "repo_index")]
    assert got[5].error_code == -32601
