"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from checks import tables
from checks.queries import queries
from shopledger.sources import cells
from shopledger.sources.mrp import flatten_mrp
from tests.conftest import SMALL

QUERIES = queries()
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "PythonUDF",
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield {name: plan(query(spark, SMALL)) for name, query in QUERIES.items()}
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_python(plans, name):
    assert not [word for word in FORBIDDEN if word in plans[name]]


def test_windows_are_partitioned(plans):
    # The one window without partition key ranks the distinct file names of a ladder.
    for name, text in plans.items():
        open_windows = [w for w in re.findall(r"windowspecdefinition\(([^,)]*)", text) if " ASC" in w]
        assert not open_windows or name in ("ladder_long", "load_plan_sheets"), name


def test_top_k_keeps_k_rows_per_task(plans):
    for name in ("prod_top_low_efficiency", "prod_top_scrap", "sales_top5", "sales_bottom5"):
        assert "TakeOrderedAndProject" in plans[name]


def test_first_row_per_timesheet_is_cut_before_the_shuffle(plans):
    text = plans["prod_scrap_by_wc"]
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_sums_are_combined_before_the_shuffle(plans):
    for name in ("platform_summary", "purchase_by_vendor", "mrp_compare", "sales_by_customer"):
        assert "partial_sum" in plans[name]
        assert "SortMergeJoin" not in plans[name] or name != "platform_summary"


def test_filters_and_columns_reach_the_scan(spark, plans):
    text = plans["prod_filtered"]
    assert "GreaterThanOrEqual(l_shipdate" in text and "In(l_returnflag" in text
    assert "GreaterThanOrEqual(l_shipdate" in plans["sales_top5_month"]
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plans["prod_top_low_efficiency"])
    assert any("l_discount" in s and "l_quantity" not in s for s in schema)
    assert not any("l_extendedprice" in s for s in schema)


def test_two_tables_are_compared_with_one_shuffle(plans):
    text = plans["mrp_compare"]
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "FullOuter" not in text


def test_shares_reuse_the_grouped_shuffle(spark):
    df = QUERIES["platform_share"](spark, SMALL)
    df.collect()
    final = plan(df)
    assert "ReusedExchange" in final or "ReusedQueryStage" in final or final.count("Reused") > 0


def final(df) -> str:
    """The plan as it ran, without the part it began with."""
    df.collect()
    return plan(df).split("Initial Plan")[0]


def test_a_grid_reads_its_periods_from_its_own_shuffle(spark):
    periods = final(QUERIES["sales_grid"](spark, SMALL))  # up to the end of the plan of the periods
    assert "ReusedExchange [period" in periods and "FileScan" not in periods


def test_kpis_sort_only_what_the_first_rows_need(plans):
    assert "SortAggregate" not in plans["prod_kpis"] and plans["prod_kpis"].count("WindowGroupLimit") == 2


def test_ladder_dates_are_slots(plans):
    assert "pivotfirst" in plans["ladder_table"].lower()
    assert "SortAggregate" not in plans["ladder_table"]


@pytest.mark.parametrize("name", ["prod_downtime_flatten", "mrp_po_lines"])
def test_sheets_are_read_once(spark, name):
    text = final(QUERIES[name](spark, SMALL))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """More rows give more tasks of the same size, which the session's number of partitions does not."""
    monkeypatch.setattr(tables.Tables.parts, "__defaults__", (100,))
    t = tables.Tables(spark, SMALL)
    parts = t.parts("lineitem")
    assert parts == -(-t.base["lineitem"].count() // 100) > 8
    for df in (QUERIES["ladder_table"](spark, SMALL), t.plan_ladder_cells(), t.sales_ladder_cells(), t.mrp_cells("post")):
        assert f", {parts}), REPARTITION_BY_NUM" in plan(df)
    raw = spark.createDataFrame([("f", 1, ["a"])], "file string, row_no long, cells array<string>")
    assert ", 17), REPARTITION_BY_NUM" in plan(flatten_mrp(raw, parts=17).po)


def test_first_rows_and_headers_are_joined_without_a_shuffle_of_cells(spark):
    rows = [(f"f{k}", n, ["Item", str(n)]) for k in range(3) for n in range(9)]
    raw = spark.createDataFrame(rows, "file string, row_no long, cells array<string>")
    for df in (cells.first_rows(raw), cells.without_edges(raw, top=2, bottom=1)):
        assert "SortMergeJoin" not in plan(df) and "Window" not in plan(df)
    assert sorted(r.row_no for r in cells.without_edges(raw, top=2, bottom=1).collect()) == sorted(3 * [2, 3, 4, 5, 6, 7])
