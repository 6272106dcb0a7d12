"""Every query against its SQL twin, and the driver contract."""

from __future__ import annotations

import pandas as pd
import pytest

import __spark_entry__ as contract
from checks.compare import canonical, check, duck
from checks.oracle import oracle_sql
from checks.queries import queries
from tests.conftest import SMALL

# The survey's catalogue of reports.
CATALOGUE = """
prod_filtered prod_kpis prod_top_low_efficiency prod_top_downtime prod_top_scrap
prod_efficiency_by_wc prod_quantity_by_wc prod_efficiency_by_employee prod_oee_by_wc
prod_hours_by_wc prod_nonprod_hours_by_wc prod_scrap_by_wc prod_run_rate
prod_employees_by_shift prod_jobs_by_shift prod_downtime_flatten prod_downtime_by_wc
prod_downtime_by_reason plan_compliance plan_missing_parts plan_detail
mrp_po_lines mrp_no_requirement mrp_po_enriched mrp_items_by_type mrp_requirement_lost
mrp_requirement_gained mrp_late_over_30 mrp_no_req_listing mrp_no_req_by_vendor
mrp_filter_options mrp_compare mrp_compare_long mrp_compare_items mrp_due_7_days mrp_late_lines
ladder_amounts ladder_by_customer ladder_by_month sales_periods sales_totals sales_grid
sales_top5 sales_bottom5 sales_by_customer sales_by_month sales_customer_series
sales_item_detail sales_customers
platform_filtered platform_options platform_summary platform_share shipto_summary
purchase_filtered purchase_options purchase_totals purchase_by_vendor purchase_by_date
purchase_calendar purchase_month_type
ladder_long ladder_table ladder_item_series ladder_items
""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_the_catalogue_is_complete():
    assert len(CATALOGUE) == 65
    assert set(CATALOGUE) <= set(queries()) <= set(contract.queries())
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query_agrees_with_its_sql(spark, con, name):
    ok, detail = check(spark, con, SMALL, name)
    assert ok, detail
    assert not detail.startswith("0 rows"), "agreement on nothing shows nothing"


def test_the_comparison_notices_differences():
    a = pd.DataFrame({"k": ["x", "y"], "v": [1.0, 2.0]})
    assert canonical(a) == canonical(a[["v", "k"]].iloc[::-1])
    assert canonical(a) != canonical(a.assign(v=[1.0, 2.0000001]))
    assert canonical(a) != canonical(a.head(1))


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["wc", "efficiency"] and df.count() == 5
