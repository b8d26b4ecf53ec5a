"""Plan guards for the training-data queries: no cartesian products or nested-loop joins, and
no Python in what is declared native."""

import pytest
from conftest import SF_SMALL

from tracelens.llm import queries

NATIVE = {"op1_fingerprints"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
PY_NODES = ("Python", "Arrow", "InPandas")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_plan_shape(spark, name):
    plan = queries.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in (*FORBIDDEN, *(PY_NODES if name in NATIVE else ())):
        assert bad not in plan, f"{name}: {bad}"
