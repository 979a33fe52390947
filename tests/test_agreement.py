"""Registered queries against their SQL on the smallest data.

A sample by default; all of them with TIDEMARK_ALL_QUERIES=1.
"""

import os

import pytest

from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "schema_contract quality_gate infer_frequency future_dates fill_edges summary_stats date_bins_box "
    "decompose_multiplicative grid_leaderboard garch_fit ljung_box arena_leaderboard root_stability sarima_evaluate "
    "arima_evaluate_moving_average pacf candidate_comparison"
).split()


def _names():
    from tidemark.plans import load_all
    from tidemark.plans.registry import SQL

    load_all()
    return sorted(SQL) if os.environ.get("TIDEMARK_ALL_QUERIES") else SAMPLE


pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.mark.parametrize("name", _names())
def test_query_agrees_with_sql(spark, name):
    from tidemark.plans.registry import PLANS, SQL

    columns, left, names, right = compare(spark, connect(FOLDER), PLANS[name], SQL[name], FOLDER)
    assert sorted(columns) == sorted(names)
    assert left == right and left
