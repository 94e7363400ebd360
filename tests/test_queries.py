"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from oracle import connect, rows_of

from marginalia.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    frame = QUERIES[name](spark, data)
    got = rows_of(frame.columns, frame.collect())
    if name not in ORACLES:
        return
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == sorted(frame.columns)
    assert got == rows_of(relation.columns, relation.fetchall())
    assert len(set(frame.columns)) == len(frame.columns)


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_does_without_the_llm_subpackage():
    """Neither the library nor its queries import the subpackage."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "marginalia").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path
