"""Every query of the core against its SQL on the smallest tables; those without SQL must give rows."""

import os

import pytest

from folioloom.plans import registry
from tests.oracle import connect, from_duckdb, from_spark

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = from_spark(registry.queries()[name](spark, FOLDER))
    if sql := registry.oracle_sql().get(name):
        want = from_duckdb(con, sql)
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        assert sum(got[1].values()) > 0


def test_entry_point(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_imports_the_optional_subpackage():
    from pathlib import Path

    import folioloom

    for p in Path(folioloom.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "folioloom.llm" not in p.read_text(), p
