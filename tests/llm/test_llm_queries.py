"""The queries of the training-data operators that SQL can express."""

import pytest

from stepwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_match_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])
