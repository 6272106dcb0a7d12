"""All tables of one application page at once, by name.

Every entry is a lazy DataFrame; nothing runs until one of them is used. A caller
who needs many of them from the same rows may ``persist()`` the inputs first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from shopledger.operators import ALL, by_key, equal_to, top_k
from shopledger.operators.filters import Dates
from shopledger.plans import ladder, mrp, platform, production, purchasing, sales
from shopledger.sources.mrp import MrpTables

Page = dict[str, DataFrame]


def production_page(
    timecards: DataFrame,
    downtime: DataFrame | None = None,
    reasons: DataFrame | None = None,
    *,
    dates: Dates | None = None,
    shifts: Sequence[str] | None = None,
    wc_types: Sequence[str] | None = None,
    wcs: Sequence[str] | None = None,
    order: Sequence[str] = production.ROW_ORDER,
) -> Page:
    """Indicators, rankings and charts of the production dashboard."""
    chosen = production.filter_timecards(timecards, dates, shifts, wc_types)
    rows = production.filter_timecards(chosen, wcs=wcs)
    sheets = production.per_timesheet(rows, order)
    page = {
        "options": production.timecard_options(timecards, dates, shifts, wc_types),
        "kpis": production.kpis(chosen, order),
        "lowest_efficiency": top_k(rows, "wc", "efficiency", "avg", descending=False),
        "most_downtime": top_k(rows, "wc", "prod_downtime_h", "sum", descending=True),
        "most_scrap": top_k(rows, "wc", "scrap", "sum", descending=True),
        "efficiency_by_wc": by_key(rows, "wc", "efficiency", "avg"),
        "quantity_by_wc": by_key(sheets, "wc", "quantity", "sum"),
        "efficiency_by_employee": by_key(rows, "employee", "efficiency", "avg", descending=True),
        "oee_by_wc": by_key(rows, "wc", "oee", "avg", descending=True),
        "hours_by_wc": by_key(sheets, "wc", "hours", "sum", descending=True),
        "idle_hours_by_wc": by_key(sheets, "wc", "nonprod_downtime_h", "sum", descending=True),
        "scrap_by_wc": by_key(sheets, "wc", "scrap", "sum", descending=True),
        "run_rate": production.run_rate(rows),
        "employees_by_shift": production.distinct_by(rows, "shift", "employee"),
        "jobs_by_shift": production.distinct_by(rows, "shift", "job_no"),
    }
    if downtime is not None:
        # without a choice, the work centres left in the filtered timecards are chosen
        centres = rows.select("wc").distinct() if wcs is None else wcs
        stops = production.filter_downtime(downtime, dates, shifts, wc_types, centres)
        page["downtime_by_wc"] = production.downtime_by_wc(stops)
        if reasons is not None:
            page["downtime_by_reason"] = production.downtime_by_reason(stops, reasons)
    return page


def plan_page(jobs: DataFrame, wc_type: str, wcs: Sequence[str] | None = None) -> Page:
    """Compliance with the production plan."""
    return {
        "options": production.plan_options(jobs, wc_type),
        "compliance": production.plan_compliance(jobs, wc_type, wcs),
        "missing_parts": production.missing_parts(jobs, wc_type, wcs),
        "detail": production.plan_detail(jobs, wc_type, wcs),
    }


def mrp_page(
    pre: MrpTables,
    post: MrpTables,
    type_: str = ALL,
    vendor: str = ALL,
    po_no: str = ALL,
    *,
    items: Sequence[str] | None = None,
    dates: Dates | None = None,
    as_of: dt.date | None = None,
) -> Page:
    """Run comparison; the detail tables need one type and one vendor."""
    before, after = mrp.enrich_po(pre.po), mrp.enrich_po(post.po)
    late = mrp.late_lines(after, as_of)
    page = {
        "options": mrp.filter_options(before, after, type_, vendor, po_no),
        "items_by_type_before": mrp.items_by_type(pre.po, pre.no_req),
        "items_by_type_after": mrp.items_by_type(post.po, post.no_req),
        "requirement_lost": mrp.requirement_lost(pre.no_req, post.no_req),
        "requirement_gained": mrp.requirement_gained(pre.no_req, post.no_req),
        "late_over_30": late,
        "late_over_30_items": mrp.item_count(late),
        "no_requirement_before": mrp.no_req_listing(pre.no_req),
        "no_requirement_after": mrp.no_req_listing(post.no_req),
        "no_requirement_by_vendor": mrp.no_req_by_vendor(pre.no_req, post.no_req),
    }
    if type_ != ALL and vendor != ALL:
        compared = mrp.compare(before, after, type_, vendor, po_no, items, dates)
        lines = equal_to(mrp.select_po(after, type_, vendor), {"po_number": po_no})
        page["comparison"] = compared
        page["comparison_items"] = mrp.compare_items(compared)
        page["comparison_long"] = mrp.compare_long(compared)
        page["alerts"] = mrp.alert_counts(lines, as_of)
        page["due_in_7_days"] = mrp.due_within(lines, as_of)
        page["overdue"] = mrp.overdue_lines(lines, as_of)
    return page


def sales_page(
    forecast: DataFrame,
    sold: DataFrame,
    *,
    grain: str = "week",
    period: dt.date | None = None,
    customer: str = ALL,
    customers: Sequence[str] | None = None,
) -> Page:
    """Forecast against sales; a customer and a period add that customer's detail."""
    page = {
        "customers": sales.customers(forecast, sold),
        "periods": sales.periods(sold, grain),
        "totals": sales.totals(forecast, sold),
        "grid": sales.grid(forecast, sold, grain),
        "top_customers": sales.top_customers(sold, 5, period, grain),
        "bottom_customers": sales.bottom_customers(sold, 5, period, grain),
        "by_customer": sales.by_customer(forecast, sold, period, grain, customers),
        "by_month": sales.by_month(forecast, sold),
    }
    if customer != ALL and period is not None:
        detail = sales.item_detail(forecast, sold, customer, period, grain)
        page["customer_series"] = sales.customer_series(forecast, sold, customer, grain)
        page["item_detail"] = detail
        page["item_detail_long"] = sales.item_detail_long(detail)
    return page


def sales_ladder_page(amounts: DataFrame, customers: Sequence[str] | None = None) -> Page:
    """The sales ladder by customer and by month."""
    return {
        "by_customer": sales.ladder_by_customer(amounts, customers),
        "by_month": sales.ladder_by_month(amounts, customers),
    }


def platform_page(
    orders: DataFrame,
    platforms: Sequence[str] | None = None,
    ship_tos: Sequence[str] | None = None,
    dates: Dates | None = None,
) -> Page:
    """Orders by platform and destination."""
    rows = platform.filter_platform_orders(orders, platforms, ship_tos, dates)
    return {
        "options": platform.platform_options(orders, platforms),
        "by_platform": platform.by_platform(rows),
        "share": platform.platform_share(rows),
        "by_ship_to": platform.by_ship_to(rows),
    }


def purchase_page(
    forecast: DataFrame,
    *,
    dates: Dates | None = None,
    vendors: Sequence[str] | None = None,
    pos: Sequence[str] | None = None,
    types: Sequence[str] | None = None,
    years: Sequence[int] | None = None,
) -> Page:
    """The purchase forecast by vendor, day, month and type."""
    rows = purchasing.filter_purchases(forecast, dates, vendors, pos, types)
    return {
        "options": purchasing.purchase_options(forecast, types, vendors, pos),
        "rows": rows,
        "totals": purchasing.purchase_totals(rows),
        "by_vendor": purchasing.by_vendor(rows),
        "by_day": purchasing.by_day(rows),
        "calendar": purchasing.calendar(rows, years),
        "month_type_series": purchasing.month_type_series(rows, years),
    }


def plan_ladder_page(long: DataFrame, dates: Sequence[dt.date], item: str) -> Page:
    """The plan ladder as a table, its items and one item's evolution."""
    return {
        "table": ladder.ladder_table(long, dates),
        "items": ladder.ladder_items(long),
        "item_series": ladder.item_series(long, item),
    }
