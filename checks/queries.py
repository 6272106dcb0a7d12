"""Every report as a query over a folder of driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import extracts, views
from checks.tables import MONTHS, Tables
from shopledger.operators import by_key, top_k
from shopledger.plans import ladder, mrp, platform, production, purchasing, sales
from shopledger.sources.contracts import SCHEDULED_JOBS, TIMECARDS
from shopledger.sources.downtime import flatten_downtime, read_downtime
from shopledger.sources.ladders import load_plan_ladder, load_sales_ladder
from shopledger.sources.mrp import MrpTables, flatten_mrp
from shopledger.sources.sinks import row_counts
from shopledger.sources.tabular import load_report, load_strict, lost_values

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(1998, 1, 1)
DATES = (dt.date(1996, 1, 1), dt.date(1999, 12, 31))
SHIFTS = ["A", "R"]
WC_TYPES = ["AMERICA", "ASIA", "EUROPE"]
WC_TYPE = "AMERICA"
TYPE, VENDOR = "ECONOMY", "Supplier#000000001"
CUSTOMER = "Customer#000000005"
SEGMENT = "BUILDING"
PERIOD = dt.date(1997, 3, 1)
WEEK = dt.date(1997, 3, 3)
PLATFORMS = ["BUILDING", "FURNITURE"]
SHIP_TOS = ["NATION_1", "NATION_2", "NATION_3"]
TYPES = ["ECONOMY", "PROMO", "SMALL"]
YEARS = list(range(1995, 2002))
ITEM = "7"
ORDER = tuple(views.LINE_ORDER)

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def _query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    def bind(fn: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


# Production


@_query
def prod_filtered(t: Tables) -> DataFrame:
    cards = t.timecards(
        "wc_type", "wc", "shift", "completed_on", "timesheet_no", "job_no", "quantity", "hours"
    )
    rows = production.filter_timecards(cards, DATES, SHIFTS, WC_TYPES)
    return rows.withColumn("completed_on", F.to_date("completed_on"))


@_query
def prod_options(t: Tables) -> DataFrame:
    cards = t.timecards("wc_type", "wc", "shift", "completed_on")
    return production.timecard_options(cards, DATES, SHIFTS, WC_TYPES)


@_query
def prod_kpis(t: Tables) -> DataFrame:
    cards = t.timecards(
        "timesheet_no", "efficiency", "oee", "quantity", "nonprod_downtime_h", ordered=True
    )
    return production.kpis(cards, ORDER)


@_query
def prod_top_low_efficiency(t: Tables) -> DataFrame:
    cards = t.timecards("wc", "efficiency")
    return top_k(cards, "wc", "efficiency", "avg", 5, descending=False)


@_query
def prod_top_downtime(t: Tables) -> DataFrame:
    cards = t.timecards("wc", "prod_downtime_h")
    return top_k(cards, "wc", "prod_downtime_h", "sum", 5, descending=True)


@_query
def prod_top_scrap(t: Tables) -> DataFrame:
    return top_k(t.timecards("wc", "scrap"), "wc", "scrap", "sum", 5, descending=True)


@_query
def prod_efficiency_by_wc(t: Tables) -> DataFrame:
    return by_key(t.timecards("wc", "efficiency"), "wc", "efficiency", "avg")


def _per_timesheet(t: Tables, measure: str) -> DataFrame:
    cards = t.timecards("timesheet_no", "wc", measure, ordered=True)
    return production.per_timesheet(cards, ORDER)


@_query
def prod_quantity_by_wc(t: Tables) -> DataFrame:
    return by_key(_per_timesheet(t, "quantity"), "wc", "quantity", "sum")


@_query
def prod_efficiency_by_employee(t: Tables) -> DataFrame:
    cards = t.timecards("employee", "efficiency")
    return by_key(cards, "employee", "efficiency", "avg", descending=True)


@_query
def prod_oee_by_wc(t: Tables) -> DataFrame:
    return by_key(t.timecards("wc", "oee"), "wc", "oee", "avg", descending=True)


@_query
def prod_hours_by_wc(t: Tables) -> DataFrame:
    return by_key(_per_timesheet(t, "hours"), "wc", "hours", "sum", descending=True)


@_query
def prod_nonprod_hours_by_wc(t: Tables) -> DataFrame:
    sheets = _per_timesheet(t, "nonprod_downtime_h")
    return by_key(sheets, "wc", "nonprod_downtime_h", "sum", descending=True)


@_query
def prod_scrap_by_wc(t: Tables) -> DataFrame:
    return by_key(_per_timesheet(t, "scrap"), "wc", "scrap", "sum", descending=True)


@_query
def prod_run_rate(t: Tables) -> DataFrame:
    return production.run_rate(t.timecards("wc", "expected_run_rate", "actual_run_rate"))


@_query
def prod_employees_by_shift(t: Tables) -> DataFrame:
    return production.distinct_by(t.timecards("shift", "employee"), "shift", "employee")


@_query
def prod_jobs_by_shift(t: Tables) -> DataFrame:
    return production.distinct_by(t.timecards("shift", "job_no"), "shift", "job_no")


@_query
def prod_downtime_flatten(t: Tables) -> DataFrame:
    flat = flatten_downtime(t.landed("downtime", t.downtime_lines))
    return flat.select("file", "wc", "downtime_h", "reason_id")


@_query
def prod_downtime_by_wc(t: Tables) -> DataFrame:
    return production.downtime_by_wc(t.view(views.DOWNTIME))


@_query
def prod_downtime_by_reason(t: Tables) -> DataFrame:
    return production.downtime_by_reason(t.view(views.DOWNTIME), t.sql(views.REASONS_SQL))


@_query
def plan_options(t: Tables) -> DataFrame:
    return production.plan_options(t.view(views.SCHEDULED_JOBS, "wc_type", "wc"), WC_TYPE)


@_query
def plan_compliance(t: Tables) -> DataFrame:
    jobs = t.view(
        views.SCHEDULED_JOBS, "wc_type", "wc", "to_make", "produced", "can_make", "remaining"
    )
    return production.plan_compliance(jobs, WC_TYPE)


@_query
def plan_missing_parts(t: Tables) -> DataFrame:
    jobs = t.view(views.SCHEDULED_JOBS, "wc_type", "wc", "can_make", "remaining")
    return production.missing_parts(jobs, WC_TYPE)


@_query
def plan_detail(t: Tables) -> DataFrame:
    return production.plan_detail(t.view(views.SCHEDULED_JOBS), WC_TYPE)


# Material requirements


def _flat_mrp(t: Tables, run: str) -> MrpTables:
    return flatten_mrp(t.landed(f"mrp-{run}", lambda: t.mrp_cells(run)), header_rows=0, parts=t.parts("lineitem"))


def _enriched(t: Tables, run: str) -> DataFrame:
    return mrp.enrich_po(
        t.po(run, "item", "type", "arrival_date", "ship_date", "qty", "vendor_po_text")
    )


def _arrival_day(df: DataFrame) -> DataFrame:
    return df.withColumn("arrival_date", F.to_date("arrival_date"))


@_query
def mrp_po_lines(t: Tables) -> DataFrame:
    po = _arrival_day(_flat_mrp(t, "post").po)
    return po.select(
        "item", "type", "arrival_date", F.to_date("ship_date").alias("ship_date"), "qty",
        "vendor_po_text",
    )


@_query
def mrp_no_requirement(t: Tables) -> DataFrame:
    return _flat_mrp(t, "post").no_req.drop("file", "row_no")


@_query
def mrp_row_counts(t: Tables) -> DataFrame:
    flat = _flat_mrp(t, "pre")
    return row_counts({"po": flat.po, "no_req": flat.no_req})


@_query
def mrp_po_enriched(t: Tables) -> DataFrame:
    po = _arrival_day(_enriched(t, "post"))
    return po.withColumn("ship_date", F.to_date("ship_date"))


@_query
def mrp_items_by_type(t: Tables) -> DataFrame:
    parts = [
        mrp.items_by_type(t.po(run, "item", "type"), t.no_req(run)).select(
            F.lit(run).alias("run"), "type", "items"
        )
        for run in ("pre", "post")
    ]
    return parts[0].unionByName(parts[1])


@_query
def mrp_requirement_lost(t: Tables) -> DataFrame:
    return mrp.requirement_lost(t.no_req("pre"), t.no_req("post"))


@_query
def mrp_requirement_gained(t: Tables) -> DataFrame:
    return mrp.requirement_gained(t.no_req("pre"), t.no_req("post"))


@_query
def mrp_late_over_30(t: Tables) -> DataFrame:
    return _arrival_day(mrp.late_lines(_enriched(t, "post"), AS_OF, 30))


@_query
def mrp_late_over_30_items(t: Tables) -> DataFrame:
    return mrp.item_count(mrp.late_lines(_enriched(t, "post"), AS_OF, 30))


@_query
def mrp_no_req_listing(t: Tables) -> DataFrame:
    return mrp.no_req_listing(t.no_req("pre"))


@_query
def mrp_no_req_totals(t: Tables) -> DataFrame:
    parts = [
        mrp.item_count(t.no_req(run)).select(F.lit(run).alias("run"), "items")
        for run in ("pre", "post")
    ]
    return parts[0].unionByName(parts[1])


@_query
def mrp_no_req_by_vendor(t: Tables) -> DataFrame:
    return mrp.no_req_by_vendor(t.no_req("pre"), t.no_req("post"))


@_query
def mrp_filter_options(t: Tables) -> DataFrame:
    return mrp.filter_options(_enriched(t, "pre"), _enriched(t, "post"), TYPE, VENDOR)


def _compared(t: Tables) -> DataFrame:
    return mrp.compare(
        _enriched(t, "pre"), _enriched(t, "post"), TYPE, VENDOR, dates=DATES
    )


@_query
def mrp_compare(t: Tables) -> DataFrame:
    return _arrival_day(_compared(t))


@_query
def mrp_compare_long(t: Tables) -> DataFrame:
    return _arrival_day(mrp.compare_long(_compared(t)))


@_query
def mrp_compare_items(t: Tables) -> DataFrame:
    return mrp.compare_items(_compared(t))


@_query
def mrp_due_7_days(t: Tables) -> DataFrame:
    return _arrival_day(mrp.due_within(t.po("post", "item", "arrival_date", "qty"), AS_OF, 7))


@_query
def mrp_late_lines(t: Tables) -> DataFrame:
    return _arrival_day(mrp.overdue_lines(t.po("post", "item", "arrival_date", "qty"), AS_OF))


@_query
def mrp_alert_counts(t: Tables) -> DataFrame:
    return mrp.alert_counts(t.po("post", "arrival_date"), AS_OF, 7)


# Sales


@_query
def ladder_amounts(t: Tables) -> DataFrame:
    return load_sales_ladder(t.landed("sales-ladder", t.sales_ladder_cells))


@_query
def ladder_by_customer(t: Tables) -> DataFrame:
    return sales.ladder_by_customer(t.sales_ladder(), ["BUILDING", "FURNITURE", "MACHINERY"])


@_query
def ladder_by_month(t: Tables) -> DataFrame:
    return sales.ladder_by_month(t.sales_ladder())


@_query
def sales_periods(t: Tables) -> DataFrame:
    return sales.periods(t.view(views.SALES, "invoice_date"), "week")


@_query
def sales_periods_month(t: Tables) -> DataFrame:
    return sales.periods(t.view(views.SALES, "invoice_date"), "month")


@_query
def sales_totals(t: Tables) -> DataFrame:
    return sales.totals(t.view(views.FORECAST, "amount"), t.view(views.SALES, "amount"))


def _both(t: Tables, *columns: str) -> tuple[DataFrame, DataFrame]:
    return (
        t.view(views.FORECAST, "ship_on", *columns),
        t.view(views.SALES, "invoice_date", *columns),
    )


@_query
def sales_grid(t: Tables) -> DataFrame:
    return sales.grid(*_both(t, "customer", "amount"), "month")


@_query
def sales_grid_week(t: Tables) -> DataFrame:
    return sales.grid(*_both(t, "customer", "amount"), "week")


@_query
def sales_top5(t: Tables) -> DataFrame:
    return sales.top_customers(t.view(views.SALES, "customer", "amount"))


@_query
def sales_top5_month(t: Tables) -> DataFrame:
    rows = t.view(views.SALES, "invoice_date", "customer", "amount")
    return sales.top_customers(rows, 5, PERIOD, "month")


@_query
def sales_bottom5(t: Tables) -> DataFrame:
    return sales.bottom_customers(t.view(views.SALES, "customer", "amount"))


@_query
def sales_by_customer(t: Tables) -> DataFrame:
    return sales.by_customer(*_both(t, "customer", "amount"))


@_query
def sales_by_customer_week(t: Tables) -> DataFrame:
    return sales.by_customer(*_both(t, "customer", "amount"), WEEK, "week")


@_query
def sales_by_month(t: Tables) -> DataFrame:
    return sales.by_month(*_both(t, "amount"))


@_query
def sales_customer_series(t: Tables) -> DataFrame:
    return sales.customer_series(*_both(t, "customer", "amount"), CUSTOMER, "month")


def _by_segment(t: Tables) -> list[DataFrame]:
    """Both sides with the market segment as customer, which has rows in every month at any scale."""
    sides = _both(t, "segment", "item", "amount")
    return [side.withColumnRenamed("segment", "customer") for side in sides]


@_query
def sales_item_detail(t: Tables) -> DataFrame:
    return sales.item_detail(*_by_segment(t), SEGMENT, PERIOD)


@_query
def sales_item_detail_long(t: Tables) -> DataFrame:
    detail = sales.item_detail(*_by_segment(t), SEGMENT, PERIOD)
    return sales.item_detail_long(detail)


@_query
def sales_customers(t: Tables) -> DataFrame:
    return sales.customers(t.view(views.FORECAST, "customer"), t.view(views.SALES, "customer"))


# Orders by platform


@_query
def platform_filtered(t: Tables) -> DataFrame:
    rows = platform.filter_platform_orders(
        t.view(views.PLATFORM_ORDERS), PLATFORMS, SHIP_TOS, DATES
    )
    return rows.withColumn("wanted_on", F.to_date("wanted_on"))


@_query
def platform_options(t: Tables) -> DataFrame:
    orders = t.view(views.PLATFORM_ORDERS, "platform", "ship_to", "wanted_on")
    return platform.platform_options(orders, PLATFORMS)


@_query
def platform_summary(t: Tables) -> DataFrame:
    return platform.by_platform(t.view(views.PLATFORM_ORDERS, "platform", "quantity", "amount"))


@_query
def platform_share(t: Tables) -> DataFrame:
    return platform.platform_share(t.view(views.PLATFORM_ORDERS, "platform", "quantity", "amount"))


@_query
def shipto_summary(t: Tables) -> DataFrame:
    return platform.by_ship_to(t.view(views.PLATFORM_ORDERS, "ship_to", "quantity", "amount"))


# Purchase forecast


@_query
def purchase_filtered(t: Tables) -> DataFrame:
    rows = purchasing.filter_purchases(
        t.view(views.PURCHASE_FORECAST), DATES, [VENDOR, "Supplier#000000002"], None, TYPES
    )
    return rows.withColumn("wanted_on", F.to_date("wanted_on"))


@_query
def purchase_options(t: Tables) -> DataFrame:
    rows = t.view(views.PURCHASE_FORECAST, "type", "vendor", "po", "wanted_on")
    return purchasing.purchase_options(rows, TYPES, [VENDOR])


@_query
def purchase_totals(t: Tables) -> DataFrame:
    return purchasing.purchase_totals(t.view(views.PURCHASE_FORECAST, "total", "quantity"))


@_query
def purchase_by_vendor(t: Tables) -> DataFrame:
    return purchasing.by_vendor(t.view(views.PURCHASE_FORECAST, "vendor", "total", "quantity"))


@_query
def purchase_by_date(t: Tables) -> DataFrame:
    return purchasing.by_day(t.view(views.PURCHASE_FORECAST, "wanted_on", "total", "quantity"))


@_query
def purchase_calendar(t: Tables) -> DataFrame:
    rows = t.view(views.PURCHASE_FORECAST, "type", "wanted_on", "quantity")
    return purchasing.calendar_wide(rows, YEARS)


@_query
def purchase_calendar_long(t: Tables) -> DataFrame:
    rows = t.view(views.PURCHASE_FORECAST, "type", "wanted_on", "quantity")
    return purchasing.calendar(rows)


@_query
def purchase_month_type(t: Tables) -> DataFrame:
    rows = t.view(views.PURCHASE_FORECAST, "type", "wanted_on", "quantity")
    return purchasing.month_type_series(rows)


# Plan ladder


@_query
def ladder_long(t: Tables) -> DataFrame:
    return load_plan_ladder(t.landed("plan-ladder", t.plan_ladder_cells)).drop("row_no")


@_query
def ladder_table(t: Tables) -> DataFrame:
    return ladder.ladder_table(t.plan_ladder(t.parts("lineitem")), MONTHS)


@_query
def ladder_item_series(t: Tables) -> DataFrame:
    return ladder.item_series(t.plan_ladder(), ITEM)


@_query
def ladder_items(t: Tables) -> DataFrame:
    return ladder.ladder_items(t.plan_ladder())


@_query
def ladder_dates(t: Tables) -> DataFrame:
    return ladder.ladder_dates(t.plan_ladder())


# Loaders, from CSV folders


TIMECARD_COLUMNS = ("wc_type", "wc", "timesheet_no", "job_no", "completed_on", "quantity", "scrap", "oee", "downtime_notes")


def _as_days(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_date(column))


@_query
def load_timecards(t: Tables) -> DataFrame:
    rows = load_report(extracts.timecards(t), TIMECARDS).rows
    return _as_days(rows.select(extracts.report_no(), *TIMECARD_COLUMNS), "completed_on")


@_query
def load_timecards_rejects(t: Tables) -> DataFrame:
    rejects = load_report(extracts.timecards(t), TIMECARDS).rejects
    return rejects.select(extracts.report_no(), F.array_join("missing", ", ").alias("missing"), "reason")


@_query
def load_timecards_lost(t: Tables) -> DataFrame:
    rows = load_report(extracts.timecards(t), TIMECARDS, lost=True).rows
    return lost_values(rows).select(extracts.report_no(), "column", "values")


@_query
def load_timecards_shift(t: Tables) -> DataFrame:
    """Loaded rows without a chosen shift: an empty choice keeps all, or none."""
    rows = load_report(extracts.timecards(t), TIMECARDS).rows
    kept = {"all": production.filter_timecards(rows, DATES), "none": production.filter_timecards(rows, DATES, shifts=[])}
    return row_counts(kept)


@_query
def load_strict_timecards(t: Tables) -> DataFrame:
    rows = load_strict(extracts.strict(t, TIMECARDS), TIMECARDS).rows
    return _as_days(
        rows.select(extracts.report_no(), "wc", "timesheet_no", "employee", "completed_on", "quantity", "hours"), "completed_on"
    )


@_query
def load_strict_jobs(t: Tables) -> DataFrame:
    rows = load_strict(extracts.strict(t, SCHEDULED_JOBS), SCHEDULED_JOBS).rows
    return _as_days(rows.select(extracts.report_no(), "wc", "job_no", "item", "due", "to_make", "can_make"), "due")


@_query
def load_strict_rejects(t: Tables) -> DataFrame:
    rejects = load_strict(extracts.strict(t, SCHEDULED_JOBS), SCHEDULED_JOBS).rejects
    return rejects.select(extracts.report_no(), F.size("found").alias("columns"), F.get("found", F.lit(0)).alias("first"), "reason")


@_query
def load_downtime(t: Tables) -> DataFrame:
    return read_downtime(extracts.downtime(t)).select(extracts.report_no(), "txt", "hours")


@_query
def load_plan_sheets(t: Tables) -> DataFrame:
    raw = extracts.ladder(t, "plan_ladder", t.plan_ladder_cells())
    return load_plan_ladder(raw).select("item", "snapshot", "plan_date", "qty")


@_query
def load_sales_sheet(t: Tables) -> DataFrame:
    return load_sales_ladder(extracts.ladder(t, "sales_ladder", t.sales_ladder_cells()))
