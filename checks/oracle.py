"""SQL twins of the queries, for DuckDB over the driver tables."""

from __future__ import annotations

from checks import extracts, views
from checks import queries as q
from checks.tables import MONTHS

PLAIN = {
    t: t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
}


def _sum(x: str) -> str:
    """Decimal sum of the values, which the views give four decimals; 0 when there are none."""
    return f"CAST(COALESCE(SUM(CAST({x} AS DECIMAL(20, 4))), 0) AS DOUBLE)"


def _mean(x: str) -> str:
    return f"({_sum(x)}) / CAST(count({x}) AS DOUBLE)"


def _day(value) -> str:
    return f"TIMESTAMP '{value.isoformat()} 00:00:00'"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


def _week(x: str) -> str:
    return f"CAST(date_trunc('week', {x}) AS DATE)"


VENDOR_AND_PO = (
    "SELECT *, CASE WHEN contains(vendor_po_text, 'P/O #') "
    "THEN trim(split_part(split_part(vendor_po_text, 'P/O #', 2), ',', 1)) "
    "ELSE 'Sin P/O' END AS po_number, "
    "CASE WHEN contains(vendor_po_text, 'Vendor') "
    "THEN trim(split_part(split_part(vendor_po_text, 'Vendor', 2), 'P/O', 1), ', ') "
    "ELSE 'Sin Vendor' END AS vendor FROM po_{run}"
)

CTES = {
    "timecards": views.TIMECARDS.sql(),
    "downtime": views.DOWNTIME.sql(),
    "jobs": views.SCHEDULED_JOBS.sql(),
    "sales": views.SALES.sql(),
    "forecast": views.FORECAST.sql(),
    "platform_orders": views.PLATFORM_ORDERS.sql(),
    "purchases": views.PURCHASE_FORECAST.sql(),
    "po_pre": views.MRP_PO["pre"].sql(),
    "po_post": views.MRP_PO["post"].sql(),
    "rich_pre": VENDOR_AND_PO.format(run="pre"),
    "rich_post": VENDOR_AND_PO.format(run="post"),
    "no_req_pre": views.no_req_sql("pre"),
    "no_req_post": views.no_req_sql("post"),
    "reasons": views.REASONS_SQL,
    "sales_ladder_lines": views.SALES_LADDER.sql(),
    "sales_ladder": (
        f"SELECT item, lmx, customer, unit_price, {_month('on_date')} AS month, "
        f"{_sum('line_amount')} AS amount FROM sales_ladder_lines GROUP BY ALL"
    ),
    "plan_ladder_lines": views.PLAN_LADDER.sql(),
    "plan_ladder": (
        "SELECT item, concat('Archivo_', CAST(snapshot_no AS STRING)) AS snapshot, "
        f"{_month('on_date')} AS plan_date, {_sum('line_qty')} AS qty "
        "FROM plan_ladder_lines GROUP BY ALL"
    ),
    "sheets": (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timesheet_no ORDER BY "
        f"{', '.join(views.LINE_ORDER)}) AS rn FROM timecards) WHERE rn = 1"
    ),
    "days_post": (
        "SELECT *, CAST(floor(CAST(epoch_us(arrival_date) AS DOUBLE) / 86400000000 - "
        f"CAST(epoch_us({_day(q.AS_OF)}) AS DOUBLE) / 86400000000) AS BIGINT) AS days_left, "
        f"CAST(floor(CAST(epoch_us({_day(q.AS_OF)}) - epoch_us(arrival_date) AS DOUBLE) "
        "/ 86400000000) AS BIGINT) AS days_past FROM rich_post"
    ),
    "comparison": (
        "SELECT COALESCE(a.item, b.item) AS item, "
        "COALESCE(a.arrival_date, b.arrival_date) AS arrival_date, "
        "COALESCE(a.qty, 0) AS qty_before, COALESCE(b.qty, 0) AS qty_after, "
        "COALESCE(b.qty, 0) - COALESCE(a.qty, 0) AS difference FROM "
        + " FULL JOIN ".join(
            f"(SELECT item, arrival_date, {_sum('qty')} AS qty FROM rich_{run} "
            f"WHERE type = '{q.TYPE}' AND vendor = '{q.VENDOR}' GROUP BY 1, 2) {alias}"
            for run, alias in (("pre", "a"), ("post", "b"))
        )
        + " ON a.item = b.item AND a.arrival_date = b.arrival_date "
        f"WHERE COALESCE(a.arrival_date, b.arrival_date) BETWEEN {_day(q.DATES[0])} "
        f"AND {_day(q.DATES[1])}"
    ),
    "month_range": (
        "SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS period "
        f"FROM (SELECT {_month('ship_on')} AS m FROM forecast "
        f"UNION ALL SELECT {_month('invoice_date')} FROM sales)"
    ),
    "item_detail": (
        "SELECT COALESCE(a.item, b.item) AS item, COALESCE(a.v, 0) AS forecast, "
        "COALESCE(b.v, 0) AS sold, COALESCE(b.v, 0) - COALESCE(a.v, 0) AS difference FROM "
        f"(SELECT item, {_sum('amount')} AS v FROM forecast WHERE segment = '{q.SEGMENT}' "
        f"AND {_month('ship_on')} = DATE '{q.PERIOD}' GROUP BY 1) a FULL JOIN "
        f"(SELECT item, {_sum('amount')} AS v FROM sales WHERE segment = '{q.SEGMENT}' "
        f"AND {_month('invoice_date')} = DATE '{q.PERIOD}' GROUP BY 1) b ON a.item = b.item"
    ),
    "monthly": (
        f"SELECT type, {_month('wanted_on')} AS month, {_sum('quantity')} AS quantity "
        "FROM purchases GROUP BY 1, 2"
    ),
}

CTES |= {
    "loaded": extracts.LOADED.sql(),
    "loaded_jobs": extracts.LOADED_JOBS.sql(),
    "reported": views.View({**views.TIMECARDS.columns, **views.LINE_ORDER, "report": extracts.REPORT}).sql(),
}

DEPENDS = {
    "rich_pre": ["po_pre"],
    "rich_post": ["po_post"],
    "sales_ladder": ["sales_ladder_lines"],
    "plan_ladder": ["plan_ladder_lines"],
    "sheets": ["timecards"],
    "days_post": ["po_post", "rich_post"],
    "comparison": ["po_pre", "po_post", "rich_pre", "rich_post"],
    "month_range": ["forecast", "sales"],
    "item_detail": ["forecast", "sales"],
    "monthly": ["purchases"],
}


def _with(select: str, *ctes: str) -> str:
    names: list[str] = []
    for c in ctes:
        for n in [*DEPENDS.get(c, []), c]:
            if n not in names:
                names.append(n)
    names.sort(key=list(CTES).index)
    body = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {body} {select}".format(**PLAIN)


def _by(table: str, key: str, measure: str, how) -> str:
    return _with(
        f"SELECT {key}, {how(measure)} AS {measure} FROM {table} GROUP BY {key}", table
    )


def _top(table: str, key: str, measure: str, how, direction: str) -> str:
    return _with(
        f"SELECT {key}, {how(measure)} AS {measure} FROM {table} GROUP BY {key} "
        f"ORDER BY {measure} {direction}, {key} LIMIT 5",
        table,
    )


def _distinct(measure: str) -> str:
    return f"CAST(count(DISTINCT {measure}) AS BIGINT)"


def _grid(period) -> str:
    f, s = period("ship_on"), period("invoice_date")
    return _with(
        "SELECT p.period, c.customer, COALESCE(f.v, 0) AS forecast, COALESCE(s.v, 0) AS sold, "
        "COALESCE(s.v, 0) - COALESCE(f.v, 0) AS difference FROM "
        f"(SELECT {f} AS period FROM forecast UNION SELECT {s} FROM sales) p "
        "CROSS JOIN (SELECT customer FROM forecast UNION SELECT customer FROM sales) c "
        f"LEFT JOIN (SELECT {f} AS period, customer, {_sum('amount')} AS v FROM forecast "
        "GROUP BY 1, 2) f ON f.period = p.period AND f.customer = c.customer "
        f"LEFT JOIN (SELECT {s} AS period, customer, {_sum('amount')} AS v FROM sales "
        "GROUP BY 1, 2) s ON s.period = p.period AND s.customer = c.customer",
        "forecast",
        "sales",
    )


def _by_customer(forecast_where: str, sales_where: str) -> str:
    return _with(
        "SELECT COALESCE(f.customer, s.customer) AS customer, COALESCE(f.v, 0) AS forecast, "
        "COALESCE(s.v, 0) AS sold FROM "
        f"(SELECT customer, {_sum('amount')} AS v FROM forecast WHERE {forecast_where} "
        "GROUP BY 1) f FULL JOIN "
        f"(SELECT customer, {_sum('amount')} AS v FROM sales WHERE {sales_where} GROUP BY 1) s "
        "ON f.customer = s.customer",
        "forecast",
        "sales",
    )


def _calendar_wide() -> str:
    cells = ", ".join(
        f"CAST(COALESCE(SUM(quantity) FILTER (WHERE month = DATE '{y}-{m:02d}-01'), 0) AS DOUBLE) "
        f'AS "{y}-{m:02d}"'
        for y in q.YEARS
        for m in range(1, 13)
    )
    return _with(
        f"SELECT type, {cells} FROM monthly GROUP BY type "
        f"UNION ALL SELECT 'TOTAL' AS type, {cells} FROM monthly",
        "monthly",
    )


def _calendar_long() -> str:
    total = "SELECT TRUE AS is_total, 'TOTAL' AS type, month, sum(quantity) AS quantity"
    return _with(
        "SELECT k.is_total, k.type, CAST(y.year AS INTEGER) AS year, CAST(m.month AS INTEGER) AS "
        "month, monthname(make_date(CAST(y.year AS INTEGER), CAST(m.month AS INTEGER), 1)) AS "
        "month_name, CAST(COALESCE(a.quantity, 0) AS DOUBLE) AS quantity FROM "
        "(SELECT DISTINCT FALSE AS is_total, type FROM monthly UNION ALL SELECT TRUE, 'TOTAL') k "
        "CROSS JOIN (SELECT DISTINCT year(month) AS year FROM monthly) y "
        "CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN "
        "(SELECT FALSE AS is_total, type, month, quantity FROM monthly UNION ALL "
        f"{total} FROM monthly GROUP BY month) a ON a.is_total = k.is_total AND a.type = k.type "
        "AND year(a.month) = y.year AND month(a.month) = m.month",
        "monthly",
    )


def _options(parts: dict[str, str], times: str | None) -> str:
    lists = [f"SELECT DISTINCT '{n}' AS option, {body}" for n, body in parts.items()]
    if times is None:
        return " UNION ALL ".join(lists)
    bounds = [
        f"SELECT 'date_{f}' AS option, CAST(CAST({f}({times.split()[0]}) AS DATE) AS STRING) "
        f"AS value {times.split(' ', 1)[1]}"
        for f in ("min", "max")
    ]
    return " UNION ALL ".join([*lists, *bounds])


def _mrp_options() -> str:
    both = "(SELECT * FROM rich_pre UNION ALL SELECT * FROM rich_post)"
    chosen = f"{both} WHERE type = '{q.TYPE}'"
    vendor = f"{chosen} AND vendor = '{q.VENDOR}'"
    return _with(
        _options(
            {
                "type": f"type AS value FROM {both}",
                "vendor": f"vendor AS value FROM {chosen}",
                "po": f"po_number AS value FROM {vendor}",
                "item": f"item AS value FROM {vendor}",
            },
            f"arrival_date FROM {both}",
        ),
        "po_pre", "po_post", "rich_pre", "rich_post",
    )


def _platform_options() -> str:
    chosen = f"platform_orders WHERE platform IN ({_list(q.PLATFORMS)})"
    return _with(
        _options(
            {
                "platform": "platform AS value FROM platform_orders",
                "ship_to": f"ship_to AS value FROM {chosen}",
            },
            f"wanted_on FROM {chosen}",
        ),
        "platform_orders",
    )


def _purchase_options() -> str:
    chosen = f"purchases WHERE type IN ({_list(q.TYPES)})"
    vendor = f"{chosen} AND vendor = '{q.VENDOR}'"
    return _with(
        _options(
            {
                "type": "type AS value FROM purchases",
                "vendor": f"vendor AS value FROM {chosen}",
                "po": f"po AS value FROM {vendor}",
            },
            f"wanted_on FROM {vendor}",
        ),
        "purchases",
    )


def _prod_options() -> str:
    dated = (
        f"timecards WHERE completed_on BETWEEN {_day(q.DATES[0])} AND {_day(q.DATES[1])}"
    )
    shifts = f"{dated} AND shift IN ({_list(q.SHIFTS)})"
    return _with(
        _options(
            {
                "shift": f"shift AS value FROM {dated}",
                "wc_type": f"wc_type AS value FROM {shifts}",
                "wc": f"wc AS value FROM {shifts} AND wc_type IN ({_list(q.WC_TYPES)})",
            },
            "completed_on FROM timecards",
        ),
        "timecards",
    )


def _series(x: str) -> str:
    return f"SELECT {x} AS period, customer, {_sum('amount')} AS v"


def _production() -> dict[str, str]:
    return {
        "prod_filtered": _with(
            "SELECT wc_type, wc, shift, CAST(completed_on AS DATE) AS completed_on, timesheet_no, "
            f"job_no, quantity, hours FROM timecards WHERE completed_on >= {_day(q.DATES[0])} "
            f"AND completed_on <= {_day(q.DATES[1])} AND shift IN ({_list(q.SHIFTS)}) "
            f"AND wc_type IN ({_list(q.WC_TYPES)})",
            "timecards",
        ),
        "prod_options": _prod_options(),
        "plan_options": _with(
            _options(
                {
                    "wc_type": "wc_type AS value FROM jobs",
                    "wc": f"wc AS value FROM jobs WHERE wc_type = '{q.WC_TYPE}'",
                },
                None,
            ),
            "jobs",
        ),
        "prod_kpis": _with(
            f"SELECT {_mean('efficiency')} AS mean_efficiency, {_mean('oee')} AS mean_oee, "
            f"(SELECT {_sum('quantity')} FROM sheets) AS quantity, "
            f"(SELECT {_sum('nonprod_downtime_h')} FROM sheets) AS nonprod_downtime_h "
            "FROM timecards",
            "sheets",
        ),
        "prod_top_low_efficiency": _top("timecards", "wc", "efficiency", _mean, "ASC"),
        "prod_top_downtime": _top("timecards", "wc", "prod_downtime_h", _sum, "DESC"),
        "prod_top_scrap": _top("timecards", "wc", "scrap", _sum, "DESC"),
        "prod_efficiency_by_wc": _by("timecards", "wc", "efficiency", _mean),
        "prod_quantity_by_wc": _by("sheets", "wc", "quantity", _sum),
        "prod_efficiency_by_employee": _by("timecards", "employee", "efficiency", _mean),
        "prod_oee_by_wc": _by("timecards", "wc", "oee", _mean),
        "prod_hours_by_wc": _by("sheets", "wc", "hours", _sum),
        "prod_nonprod_hours_by_wc": _by("sheets", "wc", "nonprod_downtime_h", _sum),
        "prod_scrap_by_wc": _by("sheets", "wc", "scrap", _sum),
        "prod_run_rate": _with(
            f"SELECT wc, 'expected' AS kind, {_mean('expected_run_rate')} AS run_rate "
            "FROM timecards GROUP BY wc UNION ALL "
            f"SELECT wc, 'actual' AS kind, {_mean('actual_run_rate')} AS run_rate "
            "FROM timecards GROUP BY wc",
            "timecards",
        ),
        "prod_employees_by_shift": _by("timecards", "shift", "employee", _distinct),
        "prod_jobs_by_shift": _by("timecards", "shift", "job_no", _distinct),
        "prod_downtime_flatten": _with(
            "SELECT concat('downtime_', shift) AS file, wc, prod_downtime_h AS downtime_h, "
            "reason_id FROM timecards",
            "timecards",
        ),
        "prod_downtime_by_wc": _by("downtime", "wc", "downtime_h", _sum),
        "prod_downtime_by_reason": _with(
            "SELECT h.wc, h.reason_id, h.downtime_h, r.description FROM "
            f"(SELECT wc, reason_id, {_sum('downtime_h')} AS downtime_h FROM downtime "
            "GROUP BY 1, 2) h LEFT JOIN reasons r ON r.reason_id = h.reason_id",
            "downtime",
            "reasons",
        ),
        "plan_compliance": _with(
            "SELECT *, CASE WHEN produced = 0 AND to_make = 0 THEN 0 "
            "ELSE round_even(produced / nullif(to_make, 0) * 100 * 100, 0) / 100 END "
            "AS compliance_pct FROM "
            f"(SELECT wc, {_sum('to_make')} AS to_make, {_sum('produced')} AS produced, "
            f"{_sum('can_make')} AS can_make, {_sum('remaining')} AS remaining FROM jobs "
            f"WHERE wc_type = '{q.WC_TYPE}' GROUP BY wc)",
            "jobs",
        ),
        "plan_missing_parts": _with(
            "SELECT *, can_make - remaining AS missing_parts FROM "
            f"(SELECT wc, {_sum('can_make')} AS can_make, {_sum('remaining')} AS remaining "
            f"FROM jobs WHERE wc_type = '{q.WC_TYPE}' GROUP BY wc)",
            "jobs",
        ),
        "plan_detail": _with(f"SELECT * FROM jobs WHERE wc_type = '{q.WC_TYPE}'", "jobs"),
    }


def _mrp() -> dict[str, str]:
    line = "CAST(arrival_date AS DATE) AS arrival_date"
    due = f"SELECT item, {line}, days_left, qty FROM days_post WHERE days_left BETWEEN 0 AND 7"
    late = "FROM days_post WHERE po_number <> 'Sin P/O' AND days_past > 30"
    full = (
        f"SELECT item, type, {line}, CAST(ship_date AS DATE) AS ship_date, qty, vendor_po_text"
    )
    per_run = [
        f"SELECT '{run}' AS run, type, CAST(sum(n) AS BIGINT) AS items FROM "
        f"(SELECT type, count(DISTINCT item) AS n FROM po_{run} GROUP BY type UNION ALL "
        f"SELECT type, count(DISTINCT item) FROM no_req_{run} GROUP BY type) GROUP BY type"
        for run in ("pre", "post")
    ]
    vendors = [
        f"SELECT '{label}' AS run, vendor, {_distinct('item')} AS items "
        f"FROM no_req_{run} GROUP BY vendor"
        for run, label in (("pre", "Antes"), ("post", "Después"))
    ]
    totals = [
        f"SELECT '{run}' AS run, {_distinct('item')} AS items FROM no_req_{run}"
        for run in ("pre", "post")
    ]
    no_reqs = ("no_req_pre", "no_req_post")
    return {
        "mrp_po_lines": _with(f"{full} FROM po_post", "po_post"),
        "mrp_no_requirement": _with("SELECT * FROM no_req_post", "no_req_post"),
        "mrp_row_counts": _with(
            "SELECT 'po' AS \"table\", CAST(count(*) AS BIGINT) AS \"rows\" FROM po_pre UNION ALL "
            "SELECT 'no_req', CAST(count(*) AS BIGINT) FROM no_req_pre",
            "po_pre",
            "no_req_pre",
        ),
        "mrp_po_enriched": _with(f"{full}, po_number, vendor FROM rich_post", "rich_post"),
        "mrp_items_by_type": _with(" UNION ALL ".join(per_run), "po_pre", "po_post", *no_reqs),
        "mrp_requirement_lost": _with(
            "SELECT item FROM no_req_post EXCEPT SELECT item FROM no_req_pre", *no_reqs
        ),
        "mrp_requirement_gained": _with(
            "SELECT item FROM no_req_pre EXCEPT SELECT item FROM no_req_post", *no_reqs
        ),
        "mrp_late_over_30": _with(
            f"SELECT item, po_number, vendor, {line}, days_past AS days_late, qty {late}",
            "days_post",
        ),
        "mrp_late_over_30_items": _with(f"SELECT {_distinct('item')} AS items {late}", "days_post"),
        "mrp_no_req_listing": _with("SELECT item, vendor FROM no_req_pre", "no_req_pre"),
        "mrp_no_req_totals": _with(" UNION ALL ".join(totals), *no_reqs),
        "mrp_no_req_by_vendor": _with(" UNION ALL ".join(vendors), *no_reqs),
        "mrp_filter_options": _mrp_options(),
        "mrp_compare": _with(
            f"SELECT item, {line}, qty_before, qty_after, difference FROM comparison", "comparison"
        ),
        "mrp_compare_long": _with(
            f"SELECT item, {line}, run, qty FROM (SELECT item, arrival_date, 'qty_before' AS run, "
            "qty_before AS qty FROM comparison UNION ALL SELECT item, arrival_date, 'qty_after', "
            "qty_after FROM comparison)",
            "comparison",
        ),
        "mrp_compare_items": _with(
            "SELECT count(DISTINCT item) AS items FROM comparison", "comparison"
        ),
        "mrp_due_7_days": _with(due, "days_post"),
        "mrp_late_lines": _with(
            f"SELECT item, {line}, abs(days_left) AS days_late, qty FROM days_post "
            "WHERE days_left < 0",
            "days_post",
        ),
        "mrp_alert_counts": _with(
            "SELECT CAST(count(*) FILTER (WHERE days_left BETWEEN 0 AND 7) AS BIGINT) AS due_soon, "
            "CAST(count(*) FILTER (WHERE days_left < 0) AS BIGINT) AS overdue FROM days_post",
            "days_post",
        ),
    }


def _sales() -> dict[str, str]:
    label_week = "strftime(period, 'Semana %U (%d-%b)')"
    label_month = "strftime(period, '%B %Y')"
    chosen = _list(["BUILDING", "FURNITURE", "MACHINERY"])
    ladder_months = (
        "SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) "
        "AS month FROM sales_ladder"
    )
    monthly = [
        f"(SELECT {_month(c)} AS period, {_sum('amount')} AS v FROM {t} GROUP BY 1)"
        for t, c in (("forecast", "ship_on"), ("sales", "invoice_date"))
    ]
    mine = f"WHERE customer = '{q.CUSTOMER}' GROUP BY 1, 2"
    series = (
        "SELECT COALESCE(f.period, s.period) AS period, COALESCE(f.customer, s.customer) AS "
        "customer, COALESCE(f.v, 0) AS forecast, COALESCE(s.v, 0) AS sold FROM "
        f"({_series(_month('ship_on'))} FROM forecast {mine}) f FULL JOIN "
        f"({_series(_month('invoice_date'))} FROM sales {mine}) s "
        "ON f.period = s.period AND f.customer = s.customer"
    )
    both = ("forecast", "sales")
    return {
        "ladder_amounts": _with("SELECT * FROM sales_ladder", "sales_ladder"),
        "ladder_by_customer": _with(
            f"SELECT customer, {_sum('amount')} AS amount FROM sales_ladder "
            f"WHERE customer IN ({chosen}) GROUP BY customer",
            "sales_ladder",
        ),
        "ladder_by_month": _with(
            "SELECT m.month, COALESCE(a.amount, 0) AS amount, strftime(m.month, '%b-%Y') AS label "
            f"FROM ({ladder_months}) m LEFT JOIN (SELECT month, {_sum('amount')} AS amount "
            "FROM sales_ladder GROUP BY month) a ON a.month = m.month",
            "sales_ladder",
        ),
        "sales_periods": _with(
            f"SELECT period, {label_week} AS label FROM "
            f"(SELECT DISTINCT {_week('invoice_date')} AS period FROM sales)",
            "sales",
        ),
        "sales_periods_month": _with(
            f"SELECT period, {label_month} AS label FROM "
            f"(SELECT DISTINCT {_month('invoice_date')} AS period FROM sales)",
            "sales",
        ),
        "sales_totals": _with(
            f"SELECT (SELECT {_sum('amount')} FROM forecast) AS forecast, "
            f"(SELECT {_sum('amount')} FROM sales) AS sold",
            *both,
        ),
        "sales_grid": _grid(_month),
        "sales_grid_week": _grid(_week),
        "sales_top5": _with(
            f"SELECT customer, {_sum('amount')} AS sold FROM sales GROUP BY customer "
            "ORDER BY sold DESC, customer LIMIT 5",
            "sales",
        ),
        "sales_top5_month": _with(
            f"SELECT customer, {_sum('amount')} AS sold FROM sales "
            f"WHERE {_month('invoice_date')} = DATE '{q.PERIOD}' GROUP BY customer "
            "ORDER BY sold DESC, customer LIMIT 5",
            "sales",
        ),
        "sales_bottom5": _with(
            f"SELECT customer, {_sum('amount')} AS sold FROM sales GROUP BY customer "
            "ORDER BY sold, customer LIMIT 5",
            "sales",
        ),
        "sales_by_customer": _by_customer(
            "ship_on <= (SELECT max(invoice_date) FROM sales)", "TRUE"
        ),
        "sales_by_customer_week": _by_customer(
            f"{_week('ship_on')} = DATE '{q.WEEK}'", f"{_week('invoice_date')} = DATE '{q.WEEK}'"
        ),
        "sales_by_month": _with(
            "SELECT m.period, COALESCE(f.v, 0) AS forecast, COALESCE(s.v, 0) AS sold "
            f"FROM month_range m LEFT JOIN {monthly[0]} f ON f.period = m.period "
            f"LEFT JOIN {monthly[1]} s ON s.period = m.period",
            "month_range",
        ),
        "sales_customer_series": _with(
            "SELECT period, customer, kind, CASE kind WHEN 'forecast' THEN forecast ELSE sold END "
            f"AS amount FROM ({series}) CROSS JOIN (VALUES ('forecast'), ('sold')) k(kind) "
            "WHERE NOT (forecast = 0 AND sold = 0)",
            *both,
        ),
        "sales_item_detail": _with("SELECT * FROM item_detail", "item_detail"),
        "sales_item_detail_long": _with(
            "SELECT item, 'forecast' AS kind, forecast AS amount FROM item_detail UNION ALL "
            "SELECT item, 'sold', sold FROM item_detail",
            "item_detail",
        ),
        "sales_customers": _with(
            "SELECT customer FROM forecast UNION SELECT customer FROM sales", *both
        ),
    }


def _pieces(table: str, key: str) -> str:
    return (
        f"SELECT {key}, {_sum('quantity')} AS pieces, {_sum('amount')} AS amount "
        f"FROM {table} GROUP BY {key}"
    )


def _platform() -> dict[str, str]:
    grouped = _pieces("platform_orders", "platform")
    share = ", ".join(
        f"{m} / (SELECT {_sum(m)} FROM ({grouped})) AS {m}_share" for m in ("pieces", "amount")
    )
    return {
        "platform_filtered": _with(
            "SELECT * REPLACE (CAST(wanted_on AS DATE) AS wanted_on) FROM platform_orders "
            f"WHERE platform IN ({_list(q.PLATFORMS)}) AND ship_to IN ({_list(q.SHIP_TOS)}) "
            f"AND wanted_on BETWEEN {_day(q.DATES[0])} AND {_day(q.DATES[1])}",
            "platform_orders",
        ),
        "platform_options": _platform_options(),
        "platform_summary": _with(grouped, "platform_orders"),
        "platform_share": _with(f"SELECT *, {share} FROM ({grouped})", "platform_orders"),
        "shipto_summary": _with(_pieces("platform_orders", "ship_to"), "platform_orders"),
    }


def _purchasing() -> dict[str, str]:
    sums = f"{_sum('total')} AS total, {_sum('quantity')} AS pieces"
    spine = (
        "SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) "
        "AS month FROM monthly"
    )
    return {
        "purchase_filtered": _with(
            "SELECT * REPLACE (CAST(wanted_on AS DATE) AS wanted_on) FROM purchases "
            f"WHERE wanted_on BETWEEN {_day(q.DATES[0])} AND {_day(q.DATES[1])} "
            f"AND vendor IN ('{q.VENDOR}', 'Supplier#000000002') AND type IN ({_list(q.TYPES)})",
            "purchases",
        ),
        "purchase_options": _purchase_options(),
        "purchase_totals": _with(f"SELECT {sums} FROM purchases", "purchases"),
        "purchase_by_vendor": _with(
            f"SELECT vendor, {sums} FROM purchases GROUP BY vendor", "purchases"
        ),
        "purchase_by_date": _with(
            f"SELECT CAST(wanted_on AS DATE) AS wanted_on, {sums} FROM purchases GROUP BY 1",
            "purchases",
        ),
        "purchase_calendar": _calendar_wide(),
        "purchase_calendar_long": _calendar_long(),
        "purchase_month_type": _with(
            "SELECT s.month, t.type, COALESCE(a.quantity, 0) AS quantity FROM "
            f"({spine}) s CROSS JOIN (SELECT DISTINCT type FROM monthly) t LEFT JOIN monthly a "
            "ON a.month = s.month AND a.type = t.type",
            "monthly",
        ),
    }


def _ladder() -> dict[str, str]:
    cells = ", ".join(
        f"max(qty) FILTER (WHERE plan_date = DATE '{m}') AS \"{m}\"" for m in MONTHS
    )
    return {
        "ladder_long": _with("SELECT * FROM plan_ladder", "plan_ladder"),
        "ladder_table": _with(
            f"SELECT item, snapshot, {cells}, '' AS release_date FROM plan_ladder "
            "GROUP BY item, snapshot",
            "plan_ladder",
        ),
        "ladder_item_series": _with(
            f"SELECT snapshot, plan_date, qty FROM plan_ladder WHERE item = '{q.ITEM}'",
            "plan_ladder",
        ),
        "ladder_items": _with("SELECT DISTINCT item FROM plan_ladder", "plan_ladder"),
        "ladder_dates": _with("SELECT DISTINCT plan_date FROM plan_ladder", "plan_ladder"),
    }


def _loaders() -> dict[str, str]:
    dates = f"BETWEEN DATE '{q.DATES[0]}' AND DATE '{q.DATES[1]}'"
    counted = f"SELECT 'all' AS \"table\", count(*) AS \"rows\" FROM loaded WHERE report % 4 <> 2 AND completed_on {dates}"
    return {
        "load_timecards": _with("SELECT * FROM loaded WHERE report % 4 <> 2", "loaded"),
        "load_timecards_rejects": _with(
            "SELECT DISTINCT report, 'Quantity, OEE' AS missing, 'missing columns' AS reason "
            "FROM loaded WHERE report % 4 = 2",
            "loaded",
        ),
        "load_timecards_lost": _with(
            "SELECT report, 'scrap' AS \"column\", count(*) AS \"values\" FROM reported "
            "WHERE report % 4 <> 2 AND line_1 % 4 = 1 GROUP BY report UNION ALL "
            "SELECT report, 'completed_on', count(*) FROM reported "
            "WHERE report % 4 <> 2 AND line_2 % 9 <> 0 AND line_2 % 11 = 0 GROUP BY report",
            "reported",
        ),
        "load_timecards_shift": _with(f"{counted} UNION ALL SELECT 'none', 0", "loaded"),
        "load_strict_timecards": _with(
            "SELECT report, wc, timesheet_no, employee, CAST(completed_on AS DATE) AS completed_on, quantity, hours "
            "FROM reported WHERE report % 3 = 0",
            "reported",
        ),
        "load_strict_jobs": _with("SELECT * FROM loaded_jobs WHERE report % 3 = 0", "loaded_jobs"),
        "load_strict_rejects": _with(
            "SELECT DISTINCT report, CASE WHEN report % 3 = 1 THEN 26 ELSE 27 END AS columns, "
            "CASE WHEN report % 3 = 1 THEN 'Ends On' ELSE 'Production Facility' END AS first, "
            "'different columns' AS reason FROM loaded_jobs WHERE report % 3 > 0",
            "loaded_jobs",
        ),
        "load_downtime": _with(
            "SELECT report, concat(wc, ' - ', wc_type) AS txt, "
            "CASE WHEN line_1 % 3 = 0 THEN NULL ELSE prod_downtime_h END AS hours FROM reported",
            "reported",
        ),
        "load_plan_sheets": _with("SELECT * FROM plan_ladder", "plan_ladder"),
        "load_sales_sheet": _with("SELECT * FROM sales_ladder", "sales_ladder"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_production(),
        **_mrp(),
        **_sales(),
        **_platform(),
        **_purchasing(),
        **_ladder(),
        **_loaders(),
    }
