"""Queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from oracle_check import differences, duck

from scorecraft.llm.queries import QUERIES, SQL

from .conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), SQL[name]) == []
