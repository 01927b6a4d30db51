"""Directory trees as a corpus: a Python Data Source ``corpusdir``, and Spark's own
``binaryFile`` reader for stores that are not mounted.

``spark.read.format("corpusdir").option("path", root).load()`` yields
``files(target_dir, path, content, size_bytes, mtime, error)``:

* entries named ``node_modules``, ``dist`` or ``.git`` are pruned during the
  walk (at any depth below the root), hidden and underscore names are kept
  (``binaryFile`` would drop them), bracketed names need no escaping; links to files
  are read, links to directories are not followed;
* option ``scope``: ``indexable`` (default: ``.ts``/``.tsx`` minus typings,
  tests, specs), ``naive`` (tests and specs kept) or ``all``;
* option ``targets``: ``root`` (the root is one target) or ``children``
  (every first-level directory is a target);
* option ``content``: ``false`` lists the files without opening any of them;
* bytes are decoded as UTF-8 with replacement characters; a file that can't be read is a
  row with an ``error`` and no content, never a failed job;
* filters on ``target_dir`` (equal, in) and ``path`` (equal, starts with) reach the walk,
  so subtrees that can't match are not listed.

The driver opens directories, whatever their depth, until it has ``UNITS`` of work; a
directory with many entries is dealt to several units by a hash of the names. Each
partition walks its own unit on an executor, so listing and reading are parallel and no
file list of the whole tree passes through the driver.
"""

from __future__ import annotations

import datetime as _dt
import os
import sys
import zlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from skimdex.functions import paths as P
from skimdex.functions import text as T
from skimdex.functions.paths import INDEX_EXCLUDED_SUFFIXES, NAIVE_EXCLUDED_SUFFIXES, PRUNED_NAMES, SOURCE_SUFFIXES
from skimdex.session import materialize

LISTING = "target_dir string, path string, size_bytes bigint, mtime timestamp, error string"
SCHEMA = "target_dir string, path string, content string, size_bytes bigint, mtime timestamp, error string"
#: Units of work the driver plans for, and entries of one directory in a unit.
UNITS, UNIT_ENTRIES = 256, 1000
MSG_UNREADABLE = "Cannot read file: "


def _wanted(name: str, scope: str) -> bool:
    if scope == "all":
        return True
    if not name.endswith(tuple(SOURCE_SUFFIXES)):
        return False
    excluded = INDEX_EXCLUDED_SUFFIXES if scope == "indexable" else NAIVE_EXCLUDED_SUFFIXES
    return not name.endswith(tuple(excluded))


class _Part(InputPartition):
    """A subtree, or share ``part`` of ``parts`` of the files of one directory."""

    def __init__(self, target: str, directory: str, recursive: bool, part: int = 0, parts: int = 1):
        super().__init__((target, directory, recursive, part, parts))
        self.target, self.directory, self.recursive, self.part, self.parts = target, directory, recursive, part, parts


def _directories(top: str) -> tuple[list[str], int]:
    """Subdirectories to walk and the number of other entries of a directory."""
    try:
        entries = sorted((e for e in os.scandir(top) if e.name not in PRUNED_NAMES), key=lambda e: e.name)
    except OSError:
        return [], 0
    below = [e.path for e in entries if e.is_dir(follow_symlinks=False)]
    return below, len(entries) - len(below)


class CorpusDirReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.scope = options.get("scope", "indexable")
        self.targets = options.get("targets", "root")
        self.content = options.get("content", "true").lower() != "false"
        self.only_targets: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters):
        """Filters that the walk can use; Spark applies all of them again."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "target_dir" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only_targets = wanted if self.only_targets is None else self.only_targets & wanted
            elif column == "path" and isinstance(f, EqualTo | StringStartsWith):
                self.prefixes.append(f.value)
            yield f

    def _may_hold(self, target: str, directory: str) -> bool:
        """Whether paths below ``directory`` can have all the wanted beginnings."""
        below = os.path.relpath(directory, target).replace(os.sep, "/") + "/"
        below = "" if below == "./" else below
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def partitions(self):
        if not os.path.isdir(self.root):
            return []
        tops = _directories(self.root)[0] if self.targets == "children" else [self.root]
        todo = deque((t, t) for t in tops if self.only_targets is None or t in self.only_targets)
        units: list[_Part] = []
        while todo and len(todo) + len(units) < UNITS:
            target, directory = todo.popleft()
            if not self._may_hold(target, directory):
                continue
            below, files = _directories(directory)
            todo.extend((target, d) for d in below)
            parts = -(-files // UNIT_ENTRIES)
            units += [_Part(target, directory, False, i, parts) for i in range(parts)]
        return units + [_Part(t, d, True) for t, d in todo if self._may_hold(t, d)]

    def _row(self, target: str, full: str):
        rel = os.path.relpath(full, target).replace(os.sep, "/")
        text = size = mtime = error = None
        try:
            st = os.stat(full)
            size, mtime = st.st_size, _dt.datetime.fromtimestamp(st.st_mtime, tz=_dt.timezone.utc)
            if self.content:
                with open(full, "rb") as fh:
                    text = fh.read().decode("utf-8", errors="replace")
        except OSError as e:
            error = f"{MSG_UNREADABLE}{full} ({e.strerror})"
        return (target, rel, text, size, mtime, error) if self.content else (target, rel, size, mtime, error)

    def read(self, partition: _Part):
        if partition is None:      # no partitions (missing root): nothing to read
            return
        todo = [partition.directory]
        while todo:
            directory = todo.pop()
            if not self._may_hold(partition.target, directory):
                continue
            try:
                entries = sorted(os.scandir(directory), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.name in PRUNED_NAMES:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.recursive:
                        todo.append(e.path)
                elif _wanted(e.name, self.scope) and not os.path.isdir(e.path):
                    if zlib.crc32(os.fsencode(e.name)) % partition.parts == partition.part:
                        yield self._row(partition.target, e.path)


class CorpusDirSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusdir"

    def schema(self) -> str:
        return LISTING if self.options.get("content", "true").lower() == "false" else SCHEMA

    def reader(self, schema) -> CorpusDirReader:
        return CorpusDirReader(self.options)


def _load(spark: SparkSession, root: str, **options: str) -> DataFrame:
    # Ship this module's classes by value, so executors need no installed copy.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CorpusDirSource)
    return spark.read.format("corpusdir").option("path", root).options(**options).load()


def directory_corpus(spark: SparkSession, root: str, scope: str = "indexable", targets: str = "root") -> DataFrame:
    return _load(spark, root, scope=scope, targets=targets)


def directory_listing(spark: SparkSession, root: str, scope: str = "indexable", targets: str = "root") -> DataFrame:
    """``(target_dir, path, size_bytes, mtime, error)``; no file is opened."""
    return _load(spark, root, scope=scope, targets=targets, content="false")


def binary_corpus(spark: SparkSession, root: str, scope: str = "indexable") -> DataFrame:
    """A tree in any store Spark reads, as one target: its ``binaryFile`` reader with a
    name filter, bytes decoded with replacement characters. Contents are read once and
    written as a table; files that could not be read are rows with an ``error``, found by
    the listing (which opens none). Names that begin with ``_`` or ``.`` are not listed by
    that reader; ``corpusdir`` keeps them."""
    def tree(skip: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", skip)
        found = reader.option("pathGlobFilter", "*" if scope == "all" else "*{" + ",".join(SOURCE_SUFFIXES) + "}").load(root)
        base = "/" + root.split("://", 1)[-1].strip("/") + "/"
        rel = F.regexp_replace(F.col("path"), "^[a-z]+:(//[^/]*)?", "")
        d = found.withColumn("path", F.call_function("substring", rel, F.lit(len(base) + 1))).withColumn("target_dir", F.lit(base.rstrip("/")))
        return d.where({"indexable": P.indexable("path"), "naive": P.naive_scope("path")}.get(scope, F.lit(True)))

    stat = ["target_dir", "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")]
    text = T.decode_utf8("content").alias("content")
    read = materialize(tree("true").select(*stat, text), "binary-corpus")
    lost = tree("false").select(*stat).join(read.select("path"), "path", "left_anti")
    error = F.concat(F.lit(MSG_UNREADABLE), "target_dir", F.lit("/"), "path")
    columns = ["target_dir", "path", "content", "size_bytes", "mtime", "error"]
    return read.withColumn("error", F.lit(None).cast("string")).select(*columns).unionByName(
        lost.withColumns({"content": F.lit(None).cast("string"), "error": error}).select(*columns)
    )


def write_tree(files: DataFrame, root: str) -> None:
    """Write a files table out as a directory tree ``root/<target name>/<path>``
    (each task writes its own rows; used to build trees from tables)."""

    def write_rows(rows):
        for r in rows:
            full = os.path.join(root, os.path.basename(r.target_dir), r.path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8", newline="") as fh:
                fh.write(r.content)

    files.select("target_dir", "path", "content").foreachPartition(write_rows)
