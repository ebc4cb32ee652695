"""Every query with SQL gives the SQL's rows on the smallest tables; every other one is held against a test of its own."""

import pytest
from tests.sqlcheck import connect, same_rows

from tracequarry.plans import catalog

SQL, RUN = catalog.oracle_sql(), catalog.queries()
#: Queries without SQL and the test that checks their rows or their operator.
CHECKED = {
    "a36_reward_figures": "test_operators.test_offline_relabel_against_a_loop",
    "b15_balanced_parts": "test_plugins.test_balanced_parts_of_the_documents",
    "b16_greedy_parts": "test_plugins.test_balanced_parts_of_the_documents",
    "b17_micro_batches": "test_plugins.test_balanced_parts_of_the_documents",
    "b19_group_parts": "test_plugins.test_balanced_parts_of_the_documents",
    "b20_balanced_order": "test_plugins.test_balanced_parts_of_the_documents",
    "g07_offline_relabel": "test_operators.test_offline_relabel_against_a_loop",
    "g07_relabel_summary": "test_operators.test_offline_relabel_against_a_loop",
    "j08_typed_pool": "test_operators.test_typed_pool_against_brute_force",
    "j16_tool_matching": "test_plugins.test_matched_calls_and_gates_of_the_rollouts",
    "w25_action_spans": "test_operators.test_spans_of_whole_actions",
    "w33_gate_reward": "test_plugins.test_matched_calls_and_gates_of_the_rollouts",
}


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tiny, con, name):
    same_rows(RUN[name](spark, tiny), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_without_sql(spark, tiny, name):
    import importlib

    module, test = CHECKED[name].split(".")
    assert callable(getattr(importlib.import_module(f"tests.{module}"), test))
    assert RUN[name](spark, tiny).count() > 0


def test_names_are_unique():
    from tracequarry.plans.registry import Registry

    r = Registry()
    r.add("x", lambda s, d: None)
    with pytest.raises(ValueError):
        r.add("x", lambda s, d: None)
