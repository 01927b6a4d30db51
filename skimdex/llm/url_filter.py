"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs.

A listed canonical URL sets two bits in each of four 64-bit words of one block.
The filter is a table (block, w0..w3) made by bit_or; pages look up their block,
and only the hits that pass all eight bits reach the exact join with the list,
which removes the false positives. The filter is broadcast when its counted size
allows it and joined by block otherwise.

Defined cases: null urls and urls without `://` have empty host and path, fit no
rule and no list entry; repeated pages give repeated answers; an empty list lets
everything pass; no rows in, no rows out; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import ascii_lower, bounded_broadcast, hash128, nonnull

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BITS_PER_URL = 16
WORDS = 4


def host(url: Column) -> Column:
    rest = F.regexp_extract(nonnull(url), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path(url: Column) -> Column:
    return F.regexp_extract(nonnull(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host_col: Column, path_col: Column) -> Column:
    """Host without `www.` and path without `.html` or slashes at its end; null
    without a host."""
    bare = F.regexp_replace(path_col, r"(\.html)?/*\z", "")
    return F.when(host_col != "", F.concat(F.regexp_replace(host_col, r"\Awww\.", ""), F.lit(" "), bare))


def rule_of(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(h, F.lit(n_blocks).cast("long"))


def _masks(h: Column) -> list[Column]:
    """Two bits for each word, from 48 bits of the second hash."""
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the `url` column of ``listed``."""
    h1, h2 = hash128(F.col("url"))
    return (
        listed.filter(F.col("url").isNotNull())
        .select(_block(h1, n_blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(h2))])
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def possible_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``urls`` (column `url`) that pass the filter of ``listed``."""
    n_blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    bloom = bounded_broadcast(bloom_filter(listed, n_blocks), n_blocks, 8 * (WORDS + 1))
    h1, h2 = hash128(F.col("url"))
    masks = _masks(h2)
    passes = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    return urls.withColumn("block", _block(h1, n_blocks)).join(bloom, "block").filter(passes).select(*urls.columns)


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct `url` values of ``urls`` that are listed, false positives gone."""
    listed = listed.select("url").distinct()
    hits = possible_hits(urls.select("url").filter(F.col("url").isNotNull()), listed).distinct()
    return hits.join(listed.hint("shuffle_hash"), "url", "left_semi")


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, url (canonical) of each page."""
    p = (
        pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("url", canonical(F.col("host"), F.col("path")))
    )
    blocked = listed_urls(p.filter(F.col("fit").isNull()), listed).withColumn("listed", F.lit(True))
    return p.join(blocked, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), F.lit("block")), F.lit("allow")).alias("verdict"),
        "url",
    )


def campaign_list(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs that some page reaches
    by a campaign link (a `utm_` parameter)."""
    return (
        pages.filter(F.col("url").rlike(r"[?&]utm_"))
        .select(canonical(host(F.col("url")), path(F.col("url"))).alias("url"))
        .filter(F.col("url").isNotNull())
        .distinct()
    )


def oracle(rules=RULES) -> str:
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')") for v, h, p in longest]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[2]} THEN '{x[k]}'" for x in fits) + " END"
    return rf"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS full_url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (
  SELECT *, {case(1)} AS rule, {case(0)} AS rule_verdict,
         CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || ' ' || regexp_replace(path, '(\.html)?/*$', '') END AS url
  FROM parts),
listed AS (SELECT DISTINCT url FROM ruled WHERE regexp_matches(full_url, '[?&]utm_') AND url IS NOT NULL)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
