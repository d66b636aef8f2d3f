"""Every named query against its SQL on the smallest tables."""

import pytest

from dockledger.plans import REGISTRY
from tests.parity import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, REGISTRY[name], FOLDER)
    assert ok, note


def test_every_query_has_sql():
    assert [n for n, q in REGISTRY.items() if not q.sql] == []


@pytest.fixture
def everything_is_hot(spark):
    """Limits so low that every skew-aware join and numbering takes its long way."""
    spark.conf.set("spark.dockledger.maxGroupRows", "3")
    spark.conf.set("spark.dockledger.maxBroadcastRows", "2")
    yield
    spark.conf.unset("spark.dockledger.maxGroupRows")
    spark.conf.unset("spark.dockledger.maxBroadcastRows")


@pytest.mark.parametrize(
    "name",
    [
        "doc_lines", "doc_nested", "receiving_report", "scan_batches", "group_price_tax",
        "supplier_code", "first_candidate", "price_apply", "price_apply_first_n", "write_back",
        "write_back_by_supplier", "step_progress", "step_outcomes", "unknown_material",
        "supplier_unqualified", "supplier_qualified", "value_report", "file_type_maps", "group_hook",
        "purchase_orders", "order_groups", "doc_header", "doc_required", "json_documents", "unit_lookup",
        "lines_incomplete", "run_reset", "supplier_valid_on", "decode_cut_output", "write_back_versions",
    ],
)
def test_query_agrees_with_sql_on_the_long_way(spark, con, everything_is_hot, name):
    ok, note = compare(spark, con, REGISTRY[name], FOLDER)
    assert ok, note
