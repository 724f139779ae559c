"""A sample of the registered queries against DuckDB; ``oracle_check.py`` runs them all."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "foldsafe_target foldsafe_ordered foldsafe_onehot own_label_gap union_groups split_report metric_panel "
    "policy_report paired_contrast optimism_panel encoding_gap lineage_records pixel_eligibility resize_area"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
