"""Corpora as DataFrames: ``files(target_dir, path, content, size_bytes, mtime)``.

``path`` is relative to ``target_dir`` (one target = one repository). Three
ways to get a corpus:

* :func:`documents_corpus` -- the ``documents`` table laid out as files;
* :func:`code_corpus` -- TypeScript source generated from ``part`` rows, with
  exported declarations whose expected signatures follow from the columns;
* :func:`skimdex.sources.directory.directory_corpus` -- a real directory
  tree (Python Data Source).

Each corpus also has a manifests table ``(target_dir, dir, content)`` standing
for the ``package.json`` files of its directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.functions import text as T
from skimdex.sources.tables import table

FILE_COLUMNS = ["target_dir", "path", "content", "size_bytes", "mtime"]

# Layout of the documents corpus: the file a document becomes, by doc_id % 10.
# Every value of the scope rules appears (pruned dirs, tests, specs, typings,
# hidden non-pruned dirs, other languages).
DOC_LAYOUT = [
    "{lang}/doc_{id}.ts",
    "{lang}/doc_{id}.tsx",
    "{lang}/doc_{id}.d.ts",
    "{lang}/doc_{id}.test.ts",
    "{lang}/doc_{id}.spec.ts",
    "{lang}/doc_{id}.test.tsx",
    "{lang}/doc_{id}.js",
    "node_modules/{lang}/doc_{id}.ts",
    "dist/{lang}/doc_{id}.ts",
    ".storybook/{lang}/doc_{id}.tsx",
]

BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z, mtime origin of derived corpora


def _layout_sql(template: str, lang: str, doc_id: str) -> str:
    parts = template.replace("{lang}", "\x00L\x00").replace("{id}", "\x00I\x00").split("\x00")
    out = []
    for p in parts:
        if p == "L":
            out.append(lang)
        elif p == "I":
            out.append(f"CAST({doc_id} AS STRING)")
        elif p:
            out.append("'" + p + "'")
    return " || ".join(out)


def doc_path_sql(lang: str = "lang", doc_id: str = "doc_id") -> str:
    """SQL (Spark and DuckDB) for a document's path inside its target."""
    whens = " ".join(
        f"WHEN {i} THEN {_layout_sql(t, lang, doc_id)}" for i, t in enumerate(DOC_LAYOUT)
    )
    return f"(CASE CAST({doc_id} % 10 AS INT) {whens} END)"


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: target ``/corpus/<source>``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.select(
        F.concat(F.lit("/corpus/"), "source").alias("target_dir"),
        F.expr(doc_path_sql()).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("doc_id") * 60).alias("mtime"),
        "doc_id",
    )


def documents_manifests(files: DataFrame) -> DataFrame:
    """package.json stand-ins of the documents corpus.

    Each target root has a named manifest; every ``de`` directory has one
    without a name and every ``es`` directory one with broken JSON, so the
    nearest-manifest rule (a nameless nearest manifest ends the search) shows.
    """
    dirs = files.select("target_dir", F.split("path", "/").getItem(0).alias("top")).distinct()
    roots = dirs.select(
        "target_dir",
        F.lit("").alias("dir"),
        F.concat(F.lit('{"name": "@docs/'), F.substring("target_dir", 9, 1 << 20), F.lit('"}')).alias("content"),
    ).distinct()
    langs = dirs.where(F.col("top").isin("de", "es")).select(
        "target_dir",
        F.col("top").alias("dir"),
        F.when(F.col("top") == "de", F.lit('{"private": true}')).otherwise(F.lit('{"name": "broken')).alias("content"),
    )
    return roots.unionByName(langs)


def documents_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(domain, path_prefix)``: one domain for each language's directory, others for
    pruned directories, with languages' own scopes inside ``node_modules``."""
    langs = table(spark, sf_dir, "documents").select("lang").where(F.col("lang").isNotNull()).distinct()
    scope = lambda name, prefix: langs.select(F.concat(F.lit(name), "lang").alias("domain"), F.concat(F.lit(prefix), "lang").alias("path_prefix"))
    fixed = spark.createDataFrame([("vendor", "node_modules"), ("built", "dist"), ("built", ".storybook"), ("stories", ".storybook")], "domain string, path_prefix string")
    return scope("text-", "").unionByName(scope("vendor-", "node_modules/")).unionByName(fixed)


# ---------------------------------------------------------------------------
# Generated TypeScript corpus (one file per part row)
# ---------------------------------------------------------------------------

NL = "chr(10)"
MAX_PROPS = 10      # p_size % 11
MAX_METHODS = 7     # p_size % 8
MAX_ENUM = 3        # p_size % 4 (+1 members)
LONG_UNION = 20     # extra literal members when p_size > 45


# Shapes that need the lexer's modes: nested template literals, a regex literal after a
# condition, JSX text with quotes and braces. Files of some sizes have them before their
# exports; some files end with a brace too many.
TEMPLATE = "`x ${ `y } ${1}` } {`"
REGEX = "/[{(]/"
JSX = "<p title=\"{\">don't {ready ? <b/> : null}</p>"
SHAPES = {"s % 6 = 1": f"const tpl = {TEMPLATE};", "s % 6 = 2": f"if (ready) {REGEX}.test(label);", "s % 7 = 3": f"const view = {JSX};"}
SUSPECT = "p_size % 13 = 5"
LISTED_CLASS = "p_size % 8 = 6"
DECORATED = "p_size % 5 = 3"
COMPARED = "p_size % 12 = 7"
ESCAPED = "p_size % 9 = 4"


def quoted(s: str) -> str:
    """An SQL string; "${" is parted, or Spark's parser would put a variable there."""
    return "('" + s.replace("'", "''").replace("${", "$' || '{") + "')"


def code_vars() -> dict[str, str]:
    """SQL fragments (portable between Spark SQL and DuckDB) used by the generator."""
    w1 = "split_part(p_name, ' ', 1)"
    w2 = "split_part(p_name, ' ', 2)"
    cap = lambda w: f"(upper(left({w}, 1)) || substr({w}, 2))"
    return {
        "k": "CAST(p_partkey AS STRING)",
        "s": "p_size",
        "w1": w1,
        "P": f"({cap(w1)} || {cap(w2)})",
        "brand": "p_brand",
        "TYPE": "upper(p_type)",
    }


def code_target_sql() -> str:
    return "('/repo/' || lower(p_type))"


def code_path_sql() -> str:
    ext = "(CASE WHEN p_size % 7 = 3 THEN '.tsx' ELSE '.ts' END)"
    return f"(replace(lower(p_brand), '#', '') || '/part_' || CAST(p_partkey AS STRING) || {ext})"


def code_content_sql() -> str:
    """TypeScript source of one part row, as one SQL expression."""
    v = code_vars()
    k, s, P, brand, TYPE, w1 = v["k"], v["s"], v["P"], v["brand"], v["TYPE"], v["w1"]
    has = f"({s} % 10 <> 0)"
    iface = [f"'export interface ' || {P} || 'Info' || {k} || ' {{' || {NL}"]
    for i in range(MAX_PROPS):
        opt = "?" if i % 2 == 1 else ""
        typ = ["string", "number", "Map<string, number>"][i % 3]
        iface.append(f"(CASE WHEN {s} % 11 > {i} THEN '  p{i}{opt}: {typ};' || {NL} ELSE '' END)")
    iface.append(f"'}}' || {NL} || {NL}")
    doc = (
        f"(CASE WHEN {s} % 3 <> 0 THEN '/** Loads ' || p_name || ' parts of ' || {brand} || '.'"
        f" || (CASE WHEN {s} > 40 THEN ' ' || repeat('More detail here. ', 8) ELSE '' END)"
        f" || ' */' || {NL} ELSE '' END)"
    )
    fn = [
        doc,
        f"'export ' || (CASE WHEN {s} % 4 = 2 THEN 'async ' ELSE '' END) || 'function get' || {P} || {k}",
        f"'(id: number, label = \"' || {brand} || '\", opts?: {{ strict: boolean }}'",
        f"(CASE WHEN {COMPARED} THEN ', low = id < 3, high = 7' ELSE '' END) || ')'",
        f"(CASE WHEN {s} % 4 = 1 THEN '' ELSE ': Promise<' || {P} || 'Info' || {k} || '>' END)",
        f"' {{' || {NL} || '  const brace = \"}}{{\";' || {NL} || '  return fetch(id) as any;' || {NL} || '}}' || {NL} || {NL}",
    ]
    cls = [
        f"'export class ' || {P} || 'Store' || {k} || ' {{' || {NL}",
        f"(CASE WHEN {s} % 2 = 0 THEN '  constructor(private name: string, public size = ' || CAST({s} AS STRING) || ') {{}}' || {NL} ELSE '' END)",
        f"'  private cache = new Map<string, number>();' || {NL}",
        f"(CASE WHEN {DECORATED} THEN '  @Watch(\"x\", [\"y\"])' || {NL} || '  onEvent(e: Event): void {{}}' || {NL} ELSE '' END)",
    ]
    scopes = ["public ", "protected ", "private ", ""]
    for j in range(MAX_METHODS):
        body = (
            f"'  {scopes[j % 4]}m{j}(x: number, tag = \"t{j}\"): string {{' || {NL}"
            f" || '    if (x > {j}) {{ return \"{{\"; }}' || {NL} || '    return tag;' || {NL} || '  }}' || {NL}"
        )
        cls.append(f"(CASE WHEN {s} % 8 > {j} THEN {body} ELSE '' END)")
    cls.append(f"'}}' || {NL} || {NL}")
    enum = [
        f"'export ' || (CASE WHEN {s} % 5 = 0 THEN 'const ' ELSE '' END) || 'enum ' || {P} || 'Kind' || {k} || ' {{' || {NL}"
    ]
    for i in range(MAX_ENUM + 1):
        cond = "TRUE" if i == 0 else f"{s} % 4 >= {i}"
        enum.append(f"(CASE WHEN {cond} THEN '  ' || {TYPE} || '_{i} = {i},' || {NL} ELSE '' END)")
    enum.append(f"'}}' || {NL} || {NL}")
    long_union = " || ".join(f"' | \"alpha-{i}\"'" for i in range(LONG_UNION))
    typ = [
        f"'export type ' || {P} || 'Key' || {k} || ' = \"' || {brand} || '\" | number | Array<{{ id: number; tag: \"' || {w1} || '\" }}>'",
        f"(CASE WHEN {ESCAPED} THEN ' | \"q' || chr(92) || '\"t\"' ELSE '' END)",
        f"(CASE WHEN {s} > 45 THEN {long_union} ELSE '' END)",
        f"';' || {NL} || {NL}",
    ]
    listed = f"(CASE WHEN {LISTED_CLASS} THEN 'class Late' || {k} || ' {{}}' || {NL} || 'export {{ Late' || {k} || ' as Other' || {k} || ' }};' || {NL} ELSE '' END)"
    exported = " || ".join([*iface, *fn, *cls, *enum, *typ, listed])
    tail = (
        f"'function helper' || {k} || '() {{ return \"export class Fake {{\"; }}' || {NL}"
        f" || 'const VERSION = \"' || CAST({s} AS STRING) || '\";' || {NL}"
        f" || 'export const LIMIT_' || {k} || ' = ' || CAST({s} AS STRING) || ';' || {NL}"
        f" || (CASE WHEN {SUSPECT} THEN '}}' || {NL} ELSE '' END)"
    )
    head = f"'// generated from part ' || {k} || {NL} || '// export function ghost() {{}}' || {NL} || {NL}"
    for when, line in SHAPES.items():
        head += f" || (CASE WHEN p_size{when[1:]} THEN {quoted(line)} || {NL} ELSE '' END)"
    return f"({head} || (CASE WHEN {has} THEN {exported} ELSE '' END) || {tail})"


def _spread(rows: DataFrame) -> DataFrame:
    """Generating file text is per-row work; spread the (few, small) source
    rows over the session's shuffle partitions so it runs in parallel.

    Every text takes ``p_name``, which comes out of a generator: else Spark moves filters
    on a text, with all that reads it, below the exchange and into the scan's few tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.explode_outer(F.array(c)).alias(c) if c == "p_name" else c for c in rows.columns]
    return rows.repartition(n, "p_partkey").select(*own)


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated TypeScript files, one per ``part`` row; target ``/repo/<type>``."""
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    content = F.expr(code_content_sql())
    return part.select(
        F.expr(code_target_sql()).alias("target_dir"),
        F.expr(code_path_sql()).alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("p_partkey") * 60).alias("mtime"),
        "p_partkey",
    )


def code_manifests(files: DataFrame) -> DataFrame:
    """A named manifest at every target root except ``promo``; a nameless one
    in every brand directory whose number is a multiple of 5."""
    dirs = files.select("target_dir", F.split("path", "/").getItem(0).alias("top")).distinct()
    roots = (
        dirs.select("target_dir")
        .distinct()
        .where(F.col("target_dir") != "/repo/promo")
        .select(
            "target_dir",
            F.lit("").alias("dir"),
            F.concat(F.lit('{"name": "@parts/'), F.substring("target_dir", 7, 1 << 20), F.lit('"}')).alias("content"),
        )
    )
    brands = dirs.where(F.expr("CAST(substr(top, 6) AS INT) % 5 = 0")).select(
        "target_dir", F.col("top").alias("dir"), F.lit('{"version": "1.0.0"}').alias("content")
    )
    return roots.unionByName(brands)


def manifest_names(manifests: DataFrame) -> DataFrame:
    """``name`` of each manifest; NULL when absent or when the JSON is broken."""
    # Spark's JSON functions stop after the first value; as the only entry of an array
    # the text has to be one value and nothing else.
    one = F.json_array_length(F.concat(F.lit("["), "content", F.lit("]"))) == 1
    return manifests.select("target_dir", "dir", F.when(one, F.get_json_object("content", "$.name")).alias("name"))


def with_abs_path(files: DataFrame) -> DataFrame:
    return files.withColumn("abs_path", F.concat("target_dir", F.lit("/"), "path"))


def file_measures(files: DataFrame) -> DataFrame:
    """Per-file size in KB, line count and token estimate."""
    return files.select(
        "target_dir",
        "path",
        T.size_kb("size_bytes").alias("size_kb"),
        T.line_count("content").alias("total_lines"),
        T.token_estimate("content").alias("token_estimate"),
    )


# ---------------------------------------------------------------------------
# A second version of each corpus, derived from the same tables, so that
# change detection and incremental refresh have real edits to find.
# ---------------------------------------------------------------------------

REVISION_NOTE = "\n// revised"
EDIT_SECONDS = 86400


def documents_corpus_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents corpus after edits: documents labelled toxic are deleted,
    those labelled low quality are revised (text appended, mtime +1 day), and
    every ``benchmark`` item is added as a new file of target ``/corpus/bench``."""
    v1 = documents_corpus(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = v1.join(labels, "doc_id", "left").where(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    revised = F.col("quality") == 0
    content = F.when(revised, F.concat("content", F.lit(REVISION_NOTE))).otherwise(F.col("content"))
    kept = j.select(
        "target_dir", "path", content.alias("content"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.when(revised, F.col("mtime") + F.expr(f"INTERVAL {EDIT_SECONDS} SECONDS")).otherwise(F.col("mtime")).alias("mtime"),
        "doc_id",
    )
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    added = bench.select(
        F.lit("/corpus/bench").alias("target_dir"),
        F.concat(F.lit("items/item_"), F.col("item_id").cast("string"), F.lit(".ts")).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.timestamp_seconds(F.lit(BASE_EPOCH + EDIT_SECONDS) + F.col("item_id")).alias("mtime"),
        (-1 - F.col("item_id")).alias("doc_id"),
    )
    return kept.unionByName(added)


def extra_function_sql() -> str:
    return "(chr(10) || 'export function extra' || CAST(p_partkey AS STRING) || '(): void {}' || chr(10))"


def code_corpus_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code corpus after edits: parts with ``p_size % 10 = 9`` are deleted,
    those with ``p_size % 10 = 1`` gain one exported function (mtime +1 day)."""
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    part = part.where(F.col("p_size") % 10 != 9)
    edited = F.col("p_size") % 10 == 1
    content = F.when(edited, F.concat(F.expr(code_content_sql()), F.expr(extra_function_sql()))).otherwise(
        F.expr(code_content_sql())
    )
    return part.select(
        F.expr(code_target_sql()).alias("target_dir"),
        F.expr(code_path_sql()).alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        (F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("p_partkey") * 60)
         + F.when(edited, F.expr(f"INTERVAL {EDIT_SECONDS} SECONDS")).otherwise(F.expr("INTERVAL 0 SECONDS"))).alias("mtime"),
        "p_partkey",
    )
