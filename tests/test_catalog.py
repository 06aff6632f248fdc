"""Catalog queries against their SQL twins on the smallest tables."""

import os

import pytest

from compare import compare, connect
from orthoflow.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
NAMES = os.environ.get("CATALOG", "").split(",") if os.environ.get("CATALOG") else [
    "tokenize", "document_vocabulary", "token_offsets", "near_candidates", "find_errors", "document_results",
    "mark_occurrences", "highlight_text", "apply_corrections", "second_layer", "orthography_reasons",
    "build_package", "expand_package", "apply_row_changes", "publish_version", "course_header", "revision_keys",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_is_callable_and_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["plurals", "parse_lexicon_lines"])
def test_words_are_stored_before_they_are_read_again(spark, name):
    """What is built of words used several times does not read and split all texts each time."""
    assert "text#" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_paragraphs_are_shuffled_once(spark):
    """The joined texts stay where their runs were dealt."""
    plan = QUERIES["paragraphs_from_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_words_are_distinct_before_they_are_collected(spark):
    """Rows that are collected are distinct words and not all tokens."""
    plan = QUERIES["comment_text"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
