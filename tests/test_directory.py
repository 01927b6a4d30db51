"""Directory source: walk pruning and scope during listing (FIXTURES E1, F18)."""

import os

from skimdex.session import scratch_path
from skimdex.sources import directory as D
from skimdex.sources.directory import directory_corpus

E1 = ["a.ts", "a.test.ts", "a.spec.ts", "a.d.ts", "a.test.tsx", "node_modules/x/n.ts", "dist/z.ts",
      ".storybook/b.ts", "_d.ts", "[id]/page.tsx", "deep/.git/c.ts", "a.js", "x/y/z/w/deep.ts"]


def test_walk(spark):
    root = scratch_path(spark, "test-tree")
    for p in E1:
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(b"export const v = 1;\xff\n")
    rows = directory_corpus(spark, root).collect()
    assert {r.path for r in rows} == {"a.ts", "a.test.tsx", ".storybook/b.ts", "_d.ts", "[id]/page.tsx", "x/y/z/w/deep.ts"}
    r = next(r for r in rows if r.path == "a.ts")
    assert r.size_bytes == 21 and r.content.endswith("�\n")
    naive = {r.path for r in directory_corpus(spark, root, scope="naive").collect()}
    assert {"a.test.ts", "a.spec.ts"} <= naive and "a.d.ts" not in naive
    assert directory_corpus(spark, os.path.join(root, "missing")).count() == 0


def tree(spark, paths, text="export const v = 1;\n"):
    root = scratch_path(spark, "test-tree").removeprefix("file:")
    for p in paths:
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as fh:
            fh.write(text)
    return root


def test_deep_tree_is_many_partitions(spark, monkeypatch):
    """A chain of single directories, then a wide one: planned at any depth."""
    monkeypatch.setattr(D, "UNIT_ENTRIES", 10)
    paths = [f"src/app/main/code/d{i % 9}/s{i % 4}/f{i}.ts" for i in range(90)] + [f"src/app/main/wide/w{i}.tsx" for i in range(45)]
    root = tree(spark, paths)
    parts = D.CorpusDirReader({"path": root}).partitions()
    assert len(parts) > 40 and sum(p.directory.endswith("wide") for p in parts) == 5
    monkeypatch.setattr(D, "UNITS", 6)
    few = D.CorpusDirReader({"path": root}).partitions()
    assert len(few) < 20 and any(p.recursive for p in few)
    got = sorted(r.path for r in directory_corpus(spark, root).collect())
    assert got == sorted(paths)


def test_filters_reach_the_walk(spark):
    root = tree(spark, ["a/x/1.ts", "a/y/2.ts", "b/x/3.ts", "b/xy/4.ts", "c/5.ts"])
    r = D.CorpusDirReader({"path": root, "targets": "children"})
    assert len(list(r.pushFilters([D.EqualTo(("target_dir",), f"{root}/b"), D.StringStartsWith(("path",), "x/")]))) == 2
    assert {os.path.relpath(p.directory, root) for p in r.partitions()} <= {"b", "b/x"}
    files = directory_corpus(spark, root, targets="children")
    assert [x.path for x in files.where(f"target_dir = '{root}/b' and path like 'x/%'").collect()] == ["x/3.ts"]
    assert {x.path for x in files.where(f"target_dir in ('{root}/a', '{root}/c')").collect()} == {"x/1.ts", "y/2.ts", "5.ts"}
    assert files.where("path = 'nowhere.ts'").count() == 0


def test_unreadable_files_and_links(spark):
    root = tree(spark, ["ok.ts", "deep/er/ok.ts"])
    os.symlink(os.path.join(root, "missing.ts"), os.path.join(root, "broken.ts"))
    for at in ("link.ts", "deep/er/link.ts"):
        os.symlink(os.path.join(root, "ok.ts"), os.path.join(root, at))
    os.symlink(os.path.join(root, "deep"), os.path.join(root, "loop"))
    rows = {r.path: r for r in directory_corpus(spark, root).collect()}
    assert set(rows) == {"ok.ts", "deep/er/ok.ts", "broken.ts", "link.ts", "deep/er/link.ts"}
    assert rows["broken.ts"].content is None and rows["broken.ts"].error.startswith(D.MSG_UNREADABLE)
    assert all(r.error is None and r.content for p, r in rows.items() if p != "broken.ts")
    assert abs(rows["ok.ts"].mtime.timestamp() - os.stat(os.path.join(root, "ok.ts")).st_mtime) < 1e-3


def test_listing_opens_no_file(spark, monkeypatch):
    root = tree(spark, ["a.ts", "b.ts"])
    os.chmod(os.path.join(root, "a.ts"), 0)
    listed = D.directory_listing(spark, root)
    assert "content" not in listed.columns
    assert {(r.path, r.size_bytes, r.error) for r in listed.collect()} == {("a.ts", 20, None), ("b.ts", 20, None)}
    monkeypatch.setattr("builtins.open", lambda *a, **k: (_ for _ in ()).throw(AssertionError))
    r = D.CorpusDirReader({"path": root, "content": "false"})
    assert len([x for p in r.partitions() for x in r.read(p)]) == 2


def test_binary_reader(spark):
    root = tree(spark, ["a.ts", "d/b.tsx", "c.js", "d/e.d.ts", "node_modules/n.ts", "d/f.test.ts"])
    with open(os.path.join(root, "bad.ts"), "wb") as fh:
        fh.write(b"x\xff\xfe")
    rows = {r.path: r for r in D.binary_corpus(spark, root).collect()}
    assert set(rows) == {"a.ts", "d/b.tsx", "bad.ts"}
    assert "\ufffd" in rows["bad.ts"].content and all(r.error is None for r in rows.values())
    assert "d/f.test.ts" in {r.path for r in D.binary_corpus(spark, root, "naive").collect()}
