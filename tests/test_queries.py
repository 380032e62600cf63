"""Every registered query that has SQL returns the rows of its SQL."""

import pytest

from stepwell.plans import corpus_queries, feature_queries, relational_queries, scale_queries, trace_queries

MODULES = (trace_queries, relational_queries, feature_queries, corpus_queries, scale_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(name, spark):
    from conftest import SF_DIR

    QUERIES[name](spark, SF_DIR).collect()


def test_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
