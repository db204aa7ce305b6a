"""Every query with a DuckDB equivalent gives the same rows; the others run."""

import pytest

from loomlake.registry import ORACLES, QUERIES
from tests.conftest import DATA, compare

import loomlake.plans  # noqa: F401  registers


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    a, b = compare(spark, name)
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "agent_id", "context_chars", "context"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
