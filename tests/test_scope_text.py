"""Scope rules and text measures (FIXTURES E1, E2, F7)."""

from pyspark.sql import functions as F

from conftest import make_files
from skimdex.functions import paths as P
from skimdex.functions import text as T
from skimdex.operators import budget, scope

E1 = ["a.ts", "a.test.ts", "a.spec.ts", "a.d.ts", "a.test.tsx", "node_modules/x/n.ts", "dist/z.ts",
      ".storybook/b.ts", "_d.ts", "[id]/page.tsx", "deep/.git/c.ts", "a.js", "c.tsx"]


def test_scope_rules(spark):
    files = make_files(spark, [(p, "x") for p in E1])
    idx = {r.path for r in scope.scan_indexable(files).collect()}
    naive = {r.path for r in scope.scan_naive_scope(files).collect()}
    assert idx == {"a.ts", "a.test.tsx", ".storybook/b.ts", "_d.ts", "[id]/page.tsx", "c.tsx"}
    assert naive == idx | {"a.test.ts", "a.spec.ts"}


def test_empty_corpus_has_no_rows(spark):
    files = make_files(spark, [])
    assert scope.scan_indexable(files).count() == 0
    assert budget.naive_tokens(files).count() == 0


def test_lengths_and_lines(spark):
    df = spark.createDataFrame([("a😀",), ("",), ("x\n",), ("a\r\nb",)], "t string")
    r = df.select(T.utf16_length("t").alias("n"), T.line_count("t").alias("lines"), T.token_estimate("t").alias("tok")).collect()
    assert [x.n for x in r] == [3, 0, 2, 4]
    assert [x.lines for x in r] == [1, 1, 2, 2]
    assert [x.tok for x in r] == [1, 0, 1, 1]


def test_naive_token_estimate(spark):
    files = make_files(spark, [("sample.ts", "export function hello(): void {}\n")])
    row = budget.naive_tokens(files).collect()[0]
    assert row.naive_tokens == 8 and row.naive_files == 1   # 33 chars / 4 rounds to 8


def test_size_kb_and_relative_path(spark):
    df = spark.createDataFrame([(1536, "C:\\repo\\src\\a.ts", "C:\\repo"), (1024, "/r/a/b.ts", "/r/")], "s bigint, p string, b string")
    r = df.select(T.size_kb("s").alias("kb"), P.relative_path("p", "b").alias("rel")).collect()
    assert [x.kb for x in r] == [1.5, 1.0]
    assert [x.rel for x in r] == ["src/a.ts", "a/b.ts"]


def test_invalid_utf8_is_replaced(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff\xfe"),)], "b binary")
    assert df.select(T.decode_utf8("b").alias("t")).first().t == "ok\ufffd\ufffd"


def test_normalize_and_within(spark):
    df = spark.createDataFrame([("/base", "a/../b.ts"), ("/base", "../x.ts"), ("/base", "./a/./c.ts"), ("/base/", "a.ts")], "b string, p string")
    r = df.select(P.join_path("b", "p").alias("j"), P.normalize("b").alias("nb")).select(
        "j", P.within("j", "nb").alias("ok")).collect()
    assert [(x.j, x.ok) for x in r] == [("/base/b.ts", True), ("/x.ts", False), ("/base/a/c.ts", True), ("/base/a.ts", True)]


def test_domain_scope_takes_the_longest_prefix(spark):
    from conftest import make_files
    from skimdex.operators import scope

    files = make_files(spark, [(p, "") for p in ("src/app/a.ts", "src/application/a.ts", "src/x.ts", "lib/y.ts", "src/app/deep/er/z.ts", "top.ts")])
    scopes = spark.createDataFrame(
        [("web", "src"), ("app", "src/app"), ("deep", "src/app/deep"), ("b", "lib"), ("a", "lib"), ("a", "lib"), ("file", "src/app/a.ts")],
        "domain string, path_prefix string",
    )
    got = scope.domain_scope(files, scopes, ["size_bytes"])
    assert {r.path: r.domain for r in got.collect()} == {
        "src/app/a.ts": "file", "src/application/a.ts": "web", "src/x.ts": "web", "lib/y.ts": "a", "src/app/deep/er/z.ts": "deep",
    }
    everything = scopes.unionByName(spark.createDataFrame([("rest", "")], scopes.schema))
    assert {r.domain for r in scope.domain_scope(files, everything, []).where("path = 'top.ts'").collect()} == {"rest"}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_token_rollup_counts_each_file_once(spark):
    from skimdex.operators import budget

    costs = spark.createDataFrame(
        [("/t", "a/b/x.ts", "p", 10, 1), ("/t", "a/y.ts", "p", 20, 2), ("/t", "z.ts", None, 40, 4), ("/u", "a/b/c/d/e/f/g/x.ts", "q", 5, 0)],
        "target_dir string, path string, package_name string, naive_tokens long, skeleton_tokens long",
    )
    got = {(r.target_dir, r.package_name, r.dir, r.level): (r.files, r.naive_tokens, r.skeleton_tokens) for r in budget.token_rollup(costs).collect()}
    assert got["/t", None, None, 3] == (3, 70, 7) and got["/t", "p", None, 1] == (2, 30, 3) and got["/t", None, None, 1] == (1, 40, 4)
    assert got["/t", None, "", 2] == (3, 70, 7) and got["/t", None, "a", 2] == (2, 30, 3) and got["/t", None, "a/b", 2] == (1, 10, 1)
    assert got["/u", None, "a/b/c/d/e/f/g", 2] == (1, 5, 0) and len(got) == 16


def test_manifest_with_trailing_junk_has_no_name(spark):
    from skimdex.sources.corpus import manifest_names

    d = spark.createDataFrame([("/t", "a", '{"name":"x"} junk'), ("/t", "b", '{"name":"y"}'), ("/t", "c", None)], "target_dir string, dir string, content string")
    assert {r.dir: r.name for r in manifest_names(d).collect()} == {"a": None, "b": "y", "c": None}
