"""Registered queries against their DuckDB text on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# one or two of each family; `python tests/oracle.py [sf0.01] [prefix ...]` runs all of them
SAMPLE = ("a03_flatten_klines", "a08_append_ledger", "b07_coverage_report", "b12_event_coverage", "c05_monthly_snapshots",
          "d05_ewma", "d16_rolling_beta", "e11_refit_dates", "f07_buffered_basket", "f12_cap_budget", "g09_settle_funding",
          "h07_series_metrics", "i03_wf_windows", "i06_select_rosters", "j10_non_overlap", "k13_holdings_weekly", "l03_upsert_candles")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    problem, _ = oracle.compare(E.queries()[name](spark, SF), duck, E.oracle_sql()[name])
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(E.registry.QUERIES) == set(E.registry.ORACLE)


def test_hash_based_queries_are_deterministic(spark):
    q = E.queries()["f17_random_signs"]
    assert q(spark, SF).exceptAll(q(spark, SF)).count() == 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
