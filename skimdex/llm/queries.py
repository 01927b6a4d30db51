"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from skimdex.llm import chat_format, exact_dedup, fingerprint, lang_id, lexical, line_dedup, minhash_forest, mixing, packing, quality_rules, suffix_dedup, token_align, url_filter
from skimdex.llm.common import documents
from skimdex.sources.tables import table


def op1_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_chat_format(spark, sf_dir):
    turns = chat_format.canonical_turns(table(spark, sf_dir, "conversations"))
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(chat_format.PROBE).alias("prompt"), F.lit(chat_format.PROBE).alias("response"))
    return chat_format.digest(chat_format.format_turns(turns.unionByName(chat_format.canonical_turns(probe))))


def op4_language_id(spark, sf_dir):
    out = lang_id.language_id(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_mixing(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark, sf_dir):
    out = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_quality_rules(spark, sf_dir):
    out = quality_rules.quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.url_filter(pages, url_filter.campaign_list(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_minhash(spark, sf_dir):
    out = minhash_forest.near_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


#: Folder of the public tokenizer files on the driver; tasks get their contents.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op11_token_align(spark, sf_dir, tokenizers=TOKENIZERS):
    return token_align.token_align(documents(spark, sf_dir), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op12_fingerprint(spark, sf_dir):
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_line_dedup, op3_chat_format, op4_language_id, op5_mixing, op6_exact_dedup, op7_quality_rules, op8_url_filters, op9_minhash, op10_suffix_dedup, op11_token_align, op12_fingerprint, op13_lexical_search)
}
ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_url_filters": url_filter.oracle(),
    "op13_lexical_search": lexical.ORACLE,
}
