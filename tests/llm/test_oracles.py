"""The opN queries that have SQL, against it."""

from __future__ import annotations

import os

import oracle
import pytest

from sieveworks.llm import queries

SF = os.environ.get("SIEVEWORKS_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    assert oracle.difference(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


def test_each_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
