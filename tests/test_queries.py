"""Every query of the core against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidewater import queries


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, tiny, con):
    assert rows_of(queries.QUERIES[name](spark, tiny)) == rows_of_sql(con, queries.SQL[name])


def test_all_have_sql_but_the_fuzzy_ratio():
    assert set(queries.QUERIES) - set(queries.SQL) == {"find_fuzzy_duplicates"}
