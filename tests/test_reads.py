"""Bounded reads (FIXTURES F12-F18, E3, E4)."""

from conftest import make_files
from skimdex.operators import reads

# Ten lines: blank ones, generics, an async function and a default export.
ROUTES = "\n".join([
    "// lengths between stops",
    "export type Meters = number;",
    "export const LIMIT: Meters = 40_000;",
    "",
    "export async function route(stops: string[], via?: Map<string, Meters>): Promise<Meters> {",
    "  const legs = stops.map((s) => via?.get(s) ?? 0);",
    "  return legs.reduce((sum, leg) => sum + leg, 0);",
    "}",
    "",
    "export default route;",
])


def _read(spark, reqs, extra_files=()):
    files = make_files(spark, [("sample.ts", ROUTES), ("binary.bin", "\u0000\u0001\u0002\u0000\u0003"), *extra_files])
    df = spark.createDataFrame(
        reqs, "request_id bigint, path string, base_dir string, max_lines int, symbols_only boolean, line_start int, line_end int"
    )
    return {r.request_id: r for r in reads.read_requests(df, files).collect()}


def test_modes(spark):
    r = _read(spark, [
        (1, "sample.ts", "/t", None, None, None, None),
        (2, "sample.ts", "/t", 3, None, None, None),
        (3, "sample.ts", "/t", None, None, 2, 4),
        (4, "sample.ts", "/t", None, True, None, None),
    ])
    assert r[1].mode == "full" and r[1].total_lines == 10 and "export default route;" in r[1].content
    assert r[2].mode == "capped" and r[2].lines_returned == 3
    assert "// ... [7 more lines" in r[2].content and "async function" not in r[2].content
    assert r[2].token_estimate == int(len("\n".join(ROUTES.split("\n")[:3])) / 4 + 0.5)
    assert r[3].mode == "line-range" and r[3].lines_returned == 3
    assert r[3].content == "\n".join(ROUTES.split("\n")[1:4])
    assert r[4].mode == "symbols-only" and r[4].content.startswith("// symbols-only mode: sample.ts")


def test_errors(spark):
    r = _read(spark, [
        (1, "../outside.txt", "/t", None, None, None, None),
        (2, "non-existent.ts", "/t", None, None, None, None),
        (3, "binary.bin", "/t", None, None, None, None),
    ])
    assert r[1].error.startswith("Path escapes baseDir") and r[1].error_code == -32603
    assert r[2].error.startswith("File not found")
    assert r[3].error.startswith("Binary file")
    assert all(x.content is None for x in r.values())


def test_js_slice_rules(spark):
    lines = ROUTES.split("\n")
    cases = {1: (0, 3), 2: (3, 2), 3: (5, 999), 4: (1, -1)}
    r = _read(spark, [(k, "sample.ts", "/t", None, None, s, e) for k, (s, e) in cases.items()])
    for k, (s, e) in cases.items():
        want = lines[s - 1:e] if s - 1 >= 0 else lines[max(len(lines) + s - 1, 0):e]
        assert r[k].content == "\n".join(want), k
        assert r[k].lines_returned == len(want)


def test_zero_and_negative_cap(spark):
    r = _read(spark, [(1, "sample.ts", "/t", 0, None, None, None), (2, "sample.ts", "/t", -1, None, None, None)])
    assert r[1].mode == "capped" and r[1].lines_returned == 0 and "[10 more lines" in r[1].content
    assert r[2].mode == "capped" and r[2].lines_returned == -1 and "[11 more lines" in r[2].content
    assert r[2].content.startswith("\n".join(ROUTES.split("\n")[:9]))
