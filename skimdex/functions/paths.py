"""Path expressions: scope predicates, relative paths, normalisation, ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference behaviour: directory entries skipped during the
# walk, and the file-name rules of the two scopes.
PRUNED_NAMES = ["node_modules", "dist", ".git"]
SOURCE_SUFFIXES = [".ts", ".tsx"]
INDEX_EXCLUDED_SUFFIXES = [".d.ts", ".test.ts", ".spec.ts"]
NAIVE_EXCLUDED_SUFFIXES = [".d.ts"]
PACKAGE_SEARCH_LEVELS = 6     # nearest package.json: own dir plus 5 parents
MANIFEST_FILE = "package.json"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def segments(path: Column | str) -> Column:
    return F.split(_c(path), "/")


def not_pruned(rel_path: Column | str) -> Column:
    """No path segment below the target is one of the pruned names."""
    return ~F.arrays_overlap(segments(rel_path), F.array(*[F.lit(n) for n in PRUNED_NAMES]))


def _ends_any(name: Column, suffixes: list[str]) -> Column:
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | F.endswith(name, F.lit(s))
    return cond


def indexable(rel_path: Column | str) -> Column:
    """Files the skeleton indexes: .ts/.tsx, minus .d.ts, .test.ts, .spec.ts."""
    p = _c(rel_path)
    return not_pruned(p) & _ends_any(p, SOURCE_SUFFIXES) & ~_ends_any(p, INDEX_EXCLUDED_SUFFIXES)


def naive_scope(rel_path: Column | str) -> Column:
    """Files the load-everything estimate counts: .ts/.tsx minus .d.ts."""
    p = _c(rel_path)
    return not_pruned(p) & _ends_any(p, SOURCE_SUFFIXES) & ~_ends_any(p, NAIVE_EXCLUDED_SUFFIXES)


def relative_path(abs_path: Column | str, base: Column | str) -> Column:
    """Path below ``base`` with backslashes turned into slashes."""
    a = F.replace(_c(abs_path), F.lit("\\"), F.lit("/"))
    b = F.regexp_replace(F.replace(_c(base), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(a == b, F.lit("")).when(
        F.startswith(a, F.concat(b, F.lit("/"))), F.substring(a, F.length(b) + 2, 1 << 30)
    )


def normalize(path: Column | str) -> Column:
    """Lexical normalisation of an absolute or relative '/'-path.

    Folds the segments: '' and '.' are dropped, '..' pops one segment. An
    absolute path keeps its leading '/'. Symlinks are not resolved.
    """
    p = _c(path)
    folded = F.aggregate(
        segments(p),
        F.lit(""),
        lambda acc, s: F.when(s == "..", F.regexp_replace(acc, "/?[^/]*$", ""))
        .when((s == ".") | (s == ""), acc)
        .when(acc == "", s)
        .otherwise(F.concat(acc, F.lit("/"), s)),
    )
    return F.when(F.startswith(p, F.lit("/")), F.concat(F.lit("/"), folded)).otherwise(folded)


def join_path(base: Column | str, rel: Column | str) -> Column:
    """path.join(base, rel) followed by normalisation."""
    return normalize(F.concat(_c(base), F.lit("/"), _c(rel)))


def within(path_norm: Column | str, base_norm: Column | str) -> Column:
    """True when the normalised path equals the base or lies below it."""
    p, b = _c(path_norm), _c(base_norm)
    return (p == b) | F.startswith(p, F.concat(F.regexp_replace(b, "/$", ""), F.lit("/")))


def dirname(path: Column | str) -> Column:
    """Parent directory of a '/'-path; '' for a top-level name."""
    segs = segments(path)
    return F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/")


def ancestors(dir_col: Column | str, levels: int = PACKAGE_SEARCH_LEVELS) -> Column:
    """ARRAY<STRUCT<lvl INT, dir STRING>>: the dir itself, then parents, at most
    ``levels`` entries; '' stands for the corpus root."""
    d = _c(dir_col)
    segs = F.when(d == "", F.array().cast("array<string>")).otherwise(F.split(d, "/"))
    n = F.size(segs)
    return F.transform(
        F.sequence(F.lit(0), F.least(F.lit(levels - 1), n)),
        lambda i: F.struct(i.alias("lvl"), F.array_join(F.slice(segs, 1, n - i), "/").alias("dir")),
    )
