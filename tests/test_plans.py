"""Plan guards for every registered query: no cartesian products or nested-loop joins,
and Python UDFs only where declared (the english analyzer's stemmer; the parser that words
what is wrong with a malformed line, which no other line reaches)."""

import pytest

from conftest import SF_SMALL

PY_UDF_ALLOWED = {"q25_search_english", "s2_quarantine_lines"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
PY_NODES = ("BatchEvalPython", "ArrowEvalPython")


def _names():
    from tracelens.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", _names())
def test_plan_shape(spark, name):
    from tracelens.plans import registry

    df = registry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    if name not in PY_UDF_ALLOWED:
        for node in PY_NODES:
            assert node not in plan, f"{name}: {node}"
