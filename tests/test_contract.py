"""The registered queries against their SQL forms at the smallest scale."""

import pytest

import __spark_entry__ as contract
from check_oracles import compare

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Their results hang on which of two nearly equal numbers is larger, so another scale is looked at as well.
RANKED = ["low_corr_filter", "top_corr_select", "mrmr_select", "smart_correlated", "woe_category_groups"]


def test_every_sql_form_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, name):
    equal, _, difference = compare(spark, SMALL, name)
    assert equal is not False, difference


@pytest.mark.parametrize("name", RANKED)
def test_ranked_query_at_a_larger_scale(spark, name):
    equal, _, difference = compare(spark, MORE, name)
    assert equal, difference


def test_entry(spark):
    assert contract.entry(spark).count() == 10
