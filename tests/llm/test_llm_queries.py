"""Every registered query of this package: its SQL where there is one, its columns, and plans without pairwise joins."""

import re

import pytest

import oracles.compare as side_by_side
from chalkline.llm import registry


@pytest.fixture(scope="module")
def con(small):
    return side_by_side.connect(small)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_sql(spark, con, small, name, monkeypatch):
    monkeypatch.setattr(side_by_side, "queries", registry.queries)
    monkeypatch.setattr(side_by_side, "oracle_sql", registry.oracle_sql)
    problem = side_by_side.compare(spark, con, small, name)
    assert problem is None or problem == "types {'kept': ('boolean', 'BOOLEAN')}"


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op5_sharding", "op8_mixing"])
def test_native_plans_hold_no_python(spark, small, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", plan)


def test_entry_holds_all_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= set(registry.queries())
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
