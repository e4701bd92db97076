"""Every registered query against its SQL, at the smallest size."""

from __future__ import annotations

import oracle
import pytest

from lodestone.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.tables(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        assert oracle.difference(df, con, registry.SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_without_the_subpackage():
    """No module outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent
    for path in (root / "lodestone").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
