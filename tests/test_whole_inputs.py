"""Queries over whole texts, all families and event types, and whole vectors stand beside the narrow ones."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
WHOLE = {"parse_choice_targets": "parse_choice_targets_whole", "pivot_scores": "pivot_scores_all_families", "union_with_source": "union_with_source_all",
         "subject_hints": "subject_hints_whole", "vector_scan": "vector_scan_whole", "l2_normalized_vectors": "l2_normalized_vectors_whole",
         "two_answer_split": "two_answer_split_texts", "pair_column_fallbacks": "pair_column_fallback_texts"}


@pytest.mark.parametrize("narrow", sorted(WHOLE))
def test_has_a_twin_of_its_own(narrow):
    assert WHOLE[narrow] in QUERIES and ORACLES[WHOLE[narrow]] != ORACLES[narrow]


def test_reads_beyond_the_cut(spark):
    texts = {r["doc_id"]: r["wrong"] for r in QUERIES["parse_choice_targets_whole"](spark, SF).collect()}
    short = {r["doc_id"]: r["wrong"] for r in QUERIES["parse_choice_targets"](spark, SF).collect()}
    assert any(len(texts[i]) > len(short[i]) + 20 for i in short)
    assert QUERIES["union_with_source_all"](spark, SF).count() > QUERIES["union_with_source"](spark, SF).count()
    hints = {(r["doc_id"], r["pos"]): r["subject"] for r in QUERIES["subject_hints_whole"](spark, SF).collect()}
    assert any(hints[r["doc_id"], r["pos"]] != r["subject"] for r in QUERIES["subject_hints"](spark, SF).collect())
