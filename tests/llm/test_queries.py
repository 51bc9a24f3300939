"""Every query of the subpackage that SQL can express against its SQL; the others give rows."""

from __future__ import annotations

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidewater.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, tiny):
    assert rows_of(queries.QUERIES[name](spark, tiny)) == rows_of_sql(connect(tiny), queries.SQL[name])


def test_each_operator_has_its_query():
    assert sorted(n.split("_")[0] for n in queries.QUERIES if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 11))
