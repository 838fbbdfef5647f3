"""Every query outside quarry.llm against its SQL on the smallest tables."""

import pytest

from quarry.plans import catalog
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, sf, name):
    assert rows_of(catalog.QUERIES[name](spark, sf)) == rows_of_sql(duck, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry_point_is_whole(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "quarry"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quarry.llm" not in path.read_text(), path


def test_registries_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
