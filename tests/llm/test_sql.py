"""Queries of this subpackage against DuckDB, on whole tables."""

from __future__ import annotations

import pytest
from oracle import difference

from tabloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), SF, ORACLE_SQL[name]) == ""
