"""Registered queries against DuckDB on the smallest tables; all of them by tests/compare.py."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
SOME = ["slice0_scores", "a5_center_synonymous", "a9_bin_average", "n1_parse_variants", "j3_apply_barcode_map", "m1_map_grid", "k5_roc", "w2_benjamini_hochberg", "t2_effects_by_class"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_every_query_has_typed_columns():
    from assaylake.plans.catalog import QUERIES

    assert all(t in "sidb" for q in QUERIES.values() for _, t in q.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
