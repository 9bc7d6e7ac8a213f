"""A spread of registered queries against their SQL; ``oracle_compare.py`` runs all of them."""

import os

import pytest

from oracle_compare import compare, duck
from tapeloom.suite import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SAMPLE = (
    "kdj brick_chart label_trades wave_measures wave_break factor_library sector_relative quintile_effect "
    "backward_adjust tick_features order_flow lexical_score asof_shares distribution_exit cross_section_ranks best_match top_sources "
    "bracketed_transform factor_matched_transform action_calibration share_moves aligned_shares reconstructed_close"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    ok, note, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
    assert ok, note


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)
