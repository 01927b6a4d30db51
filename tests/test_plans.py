"""Physical-plan properties the design relies on (one shuffle for the token
table, map-side partial aggregation, per-partition top-k, column pruning)."""

import os
import re

import pytest

from skimdex.operators import symbols as Y
from skimdex.plans.catalog import QUERIES
from skimdex.sources import corpus as C

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partial_aggregation_and_group_limit(spark):
    naive = _plan(QUERIES["naive_tokens"](spark, SF))
    assert "partial_sum" in naive
    retention = QUERIES["snapshot_retention"](spark, SF)
    assert "WindowGroupLimit" in retention._jdf.queryExecution().optimizedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["naive_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert "n_chars" not in schema and "text" in schema


def test_extraction_stays_in_its_rows(spark):
    """Up to the declarations nothing is shuffled, joined or windowed; numbering them
    takes one exchange, by file. (The other one spreads the synthetic source.)"""
    files = C.code_corpus(spark, SF)
    decls = Y.declarations(Y.statements(Y.source_candidates(files)))
    plan = _plan(decls)
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["p_partkey"]
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan
    plan = _plan(Y.symbols_from(decls))
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["p_partkey", "target_dir"]


def test_sizes_come_with_the_symbols(spark):
    """The skeleton's sizes need no second scan of the corpus."""
    from skimdex.operators import skeleton as K

    files = C.code_corpus(spark, SF)
    plan = _plan(K.skeleton_entries(Y.symbols_from(Y.declarations(Y.statements(Y.source_candidates(files))))))
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_kinds_are_chosen_before_the_members(spark):
    files = Y.source_candidates(C.code_corpus(spark, SF))
    only = Y.extract(files, ["enum"])
    assert {r.kind for r in only.select("kind").distinct().collect()} == {"enum"}
    named = Y.exported_declarations(files).where("kind = 'enum'")
    assert named.count() == only.count() > 0


def _below_the_spread(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]


def test_texts_are_read_above_the_spread(spark):
    """A filter on a generated text is not moved into the few tasks that scan ``part``."""
    from skimdex.operators import tokens as TK

    files = C.code_corpus(spark, SF)
    candidates = Y.source_candidates(files)
    for df in (TK.token_stats(files), Y.suspects(candidates), Y.statements(candidates)):
        assert "generated from part" not in _below_the_spread(df)
    assert TK.token_stats(files).count() == files.count()


def test_token_counts_lex_a_text_once(spark):
    from skimdex.operators import tokens as TK

    plan = TK.token_stats(C.code_corpus(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(translate(") == 1


def test_the_summary_lexes_no_text_beside_the_extraction(spark):
    plan = QUERIES["index_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(translate(" not in plan
