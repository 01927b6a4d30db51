"""Nearest package manifest (FIXTURES E5)."""

from skimdex.operators import packages


def test_nearest_manifest(spark):
    files = spark.createDataFrame(
        [("/t", p) for p in ["a.ts", "pkg/a.ts", "pkg/sub/a.ts", "pkg/sub/deep/a.ts", "x/1/2/3/4/5/6/a.ts", "x/1/a.ts", "bad/a.ts"]],
        "target_dir string, path string",
    )
    manifests = spark.createDataFrame(
        [("/t", "", '{"name": "root"}'), ("/t", "pkg", '{"name": "pkg"}'), ("/t", "pkg/sub", '{"private": true}'),
         ("/t", "x", '{"name": "x"}'), ("/t", "bad", "{oops")],
        "target_dir string, dir string, content string",
    )
    got = {r.path: r.package_name for r in packages.nearest_package(files, manifests).collect()}
    assert got["a.ts"] == "root"
    assert got["pkg/a.ts"] == "pkg"
    assert got["pkg/sub/a.ts"] is None          # nameless nearest manifest ends the search
    assert got["pkg/sub/deep/a.ts"] is None
    assert got["x/1/a.ts"] == "x"
    assert got["x/1/2/3/4/5/6/a.ts"] is None    # more than six levels up
    assert got["bad/a.ts"] is None              # unparsable nearest manifest
