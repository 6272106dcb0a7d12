"""Reports on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopledger.operators import by_key
from shopledger.plans import ladder, mrp, pages, platform, production, purchasing, sales
from shopledger.sources.mrp import MrpTables
from tests.conftest import rows, unordered


def at(y, m, d, h=0):
    return dt.datetime(y, m, d, h)


@pytest.fixture(scope="module")
def cards(spark):
    data = [
        ("PRESS", "P1", "A", at(2025, 1, 1), "t1", "j1", "e1", 10.0, 1.0, 80.0, 70.0, 1.0, 0.5, 1),
        ("PRESS", "P1", "A", at(2025, 1, 2), "t1", "j1", "e1", 10.0, 2.0, 90.0, 60.0, 2.0, 0.5, 2),
        ("PRESS", "P2", "A", at(2025, 1, 3, 9), "t1", "j2", "e2", 10.0, 4.0, None, 50.0, 3.0, 0.5, 3),
        ("WELD", "W1", "B", at(2025, 1, 3), "t2", "j2", "e2", 5.0, 8.0, 50.0, None, 4.0, 1.5, 4),
        (None, None, "B", None, "t3", "j3", None, 7.0, 16.0, 10.0, 10.0, 5.0, None, 5),
    ]
    schema = (
        "wc_type STRING, wc STRING, shift STRING, completed_on TIMESTAMP_NTZ, timesheet_no STRING, "
        "job_no STRING, employee STRING, quantity DOUBLE, scrap DOUBLE, efficiency DOUBLE, "
        "oee DOUBLE, prod_downtime_h DOUBLE, nonprod_downtime_h DOUBLE, row_no INT"
    )
    return spark.createDataFrame(data, schema)


def test_timecard_filters(cards):
    span = (dt.date(2025, 1, 1), dt.date(2025, 1, 3))
    assert production.filter_timecards(cards, span).count() == 3
    assert production.filter_timecards(cards, span, end_of_day=True).count() == 4
    assert production.filter_timecards(cards, shifts=["B"], wc_types=["WELD"]).count() == 1
    assert production.filter_timecards(cards, shifts=[]).count() == 0
    assert production.filter_timecards(cards).count() == 5


def test_kpis(cards):
    got = rows(production.kpis(cards, ["row_no"]))
    assert got == [(57.5, 47.5, 22.0, 2.0)]


def test_kpis_take_the_first_row_even_if_it_is_empty(spark):
    df = spark.createDataFrame(
        [("t", None, 1.0, 1.0, 1.0, 1), ("t", 5.0, 1.0, 1.0, 1.0, 2)],
        "timesheet_no STRING, quantity DOUBLE, nonprod_downtime_h DOUBLE, efficiency DOUBLE, "
        "oee DOUBLE, row_no INT",
    )
    assert rows(production.kpis(df, ["row_no"])) == [(1.0, 1.0, 0.0, 1.0)]


def test_scrap_with_and_without_repeats(cards):
    assert rows(by_key(cards, "wc", "scrap", "sum", descending=True)) == [
        ("W1", 8.0), ("P2", 4.0), ("P1", 3.0),
    ]
    sheets = production.per_timesheet(cards, ["row_no"])
    assert rows(by_key(sheets, "wc", "scrap", "sum", descending=True)) == [("W1", 8.0), ("P1", 1.0)]


def test_distinct_by_shift(cards):
    assert rows(production.distinct_by(cards, "shift", "employee")) == [("B", 1), ("A", 2)]
    assert rows(production.distinct_by(cards, "shift", "job_no")) == [("A", 2), ("B", 2)]


def test_run_rate_needs_both_means(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, None), ("b", 1.0, None)],
        "wc STRING, expected_run_rate DOUBLE, actual_run_rate DOUBLE",
    )
    assert unordered(production.run_rate(df)) == [("a", "actual", 2.0), ("a", "expected", 2.0)]


def test_downtime(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "D001"), ("b", 3.0, "D002"), ("a", 1.5, "D001"), ("b", None, "D099")],
        "wc STRING, downtime_h DOUBLE, reason_id STRING",
    )
    dim = spark.createDataFrame([("D001", "x"), ("D002", "y")], "reason_id STRING, description STRING")
    assert rows(production.downtime_by_wc(df)) == [("b", 3.0), ("a", 2.5)]
    assert rows(production.downtime_by_wc(df, ["a"])) == [("a", 2.5)]
    assert unordered(production.downtime_by_reason(df, dim)) == [
        ("a", "D001", 2.5, "x"), ("b", "D002", 3.0, "y"), ("b", "D099", 0.0, None),
    ]
    # A filter on a column the table does not have is ignored.
    assert production.filter_downtime(df, shifts=["A"], wc_types=[]).count() == 4


def test_plan(spark):
    df = spark.createDataFrame(
        [
            ("PRESS", "a", "j", "i", 3.0, 1.0, 5.0, 2.0),
            ("PRESS", "b", "j", "i", 0.0, 0.0, 0.0, 1.0),
            ("PRESS", "c", "j", "i", 0.0, 4.0, 0.0, 0.0),
            ("WELD", "d", "j", "i", 1.0, 1.0, 1.0, 1.0),
        ],
        "wc_type STRING, wc STRING, job_no STRING, item STRING, to_make DOUBLE, produced DOUBLE, "
        "can_make DOUBLE, remaining DOUBLE",
    )
    got = [(r.wc, r.compliance_pct) for r in production.plan_compliance(df, "PRESS").collect()]
    assert got == [("b", 0.0), ("a", 33.33), ("c", None)]
    missing = production.missing_parts(df, "PRESS", ["a", "b"])
    assert [(r.wc, r.missing_parts) for r in missing.collect()] == [("b", -1.0), ("a", 3.0)]
    assert production.plan_detail(df, "PRESS", []).count() == 3


PO = "item STRING, type STRING, arrival_date TIMESTAMP_NTZ, qty DOUBLE, vendor_po_text STRING"


@pytest.fixture(scope="module")
def runs(spark):
    def text(v, p):
        return f"Vendor {v}, P/O # {p}, open"

    pre = [
        ("A", "RAW", at(2025, 1, 1), 10.0, text("X", 1)),
        ("A", "RAW", at(2025, 1, 1), 5.0, text("X", 2)),
        ("B", "RAW", at(2025, 2, 1), 7.0, text("X", 1)),
        ("C", "PKG", at(2025, 2, 1), 9.0, text("Y", 3)),
    ]
    post = [
        ("A", "RAW", at(2025, 1, 1), 12.0, text("X", 1)),
        ("D", "RAW", at(2025, 3, 1, 12), 1.0, text("X", 4)),
        ("E", "RAW", at(2024, 11, 1), 1.0, "Vendor X"),
        ("F", None, None, 1.0, None),
    ]
    return tuple(mrp.enrich_po(spark.createDataFrame(d, PO)) for d in (pre, post))


def test_compare(runs):
    got = mrp.compare(*runs, "RAW", "X")
    assert unordered(got) == [
        ("A", at(2025, 1, 1), 15.0, 12.0, -3.0),
        ("B", at(2025, 2, 1), 7.0, 0.0, -7.0),
        ("D", at(2025, 3, 1, 12), 0.0, 1.0, 1.0),
        ("E", at(2024, 11, 1), 0.0, 1.0, 1.0),
    ]
    assert mrp.compare(*runs, "RAW", "X", po_no="1").count() == 2
    assert mrp.compare(*runs, "RAW", "X", items=[]).count() == 0
    span = (dt.date(2025, 1, 1), dt.date(2025, 3, 1))
    assert mrp.compare(*runs, "RAW", "X", dates=span).count() == 2
    with pytest.raises(ValueError):
        mrp.compare(*runs, "Todos", "X")
    assert mrp.compare_long(got).count() == 8
    assert rows(mrp.compare_items(got)) == [(4,)]


def test_lateness(runs):
    _, post = runs
    as_of = dt.date(2025, 2, 1)
    late = mrp.late_lines(post, as_of, 30)
    assert rows(late) == [("A", "1", "X", at(2025, 1, 1), 31, 12.0)]
    assert mrp.late_lines(post, dt.date(2025, 1, 31), 30).count() == 0
    assert rows(mrp.item_count(late)) == [(1,)]
    due = mrp.due_within(post, dt.date(2025, 2, 22), 7)
    assert rows(due) == [("D", at(2025, 3, 1, 12), 7, 1.0)]
    overdue = mrp.overdue_lines(post, dt.date(2025, 3, 2))
    assert unordered(overdue.select("item", "days_late")) == [("A", 60), ("D", 1), ("E", 121)]
    assert rows(mrp.alert_counts(post, dt.date(2025, 2, 22))) == [(1, 2)]


def test_items_and_requirements(spark, runs):
    pre, _ = runs
    schema = "item STRING, type STRING, vendor STRING"
    no_pre = spark.createDataFrame([("A", "RAW", "V1"), ("Z", "PKG", "V1")], schema)
    no_post = spark.createDataFrame([("Z", "PKG", "V1"), ("Y", "PKG", None)], schema)
    assert unordered(mrp.items_by_type(pre, no_pre)) == [("PKG", 2), ("RAW", 3)]
    assert rows(mrp.requirement_lost(no_pre, no_post)) == [("Y",)]
    assert rows(mrp.requirement_gained(no_pre, no_post)) == [("A",)]
    assert unordered(mrp.no_req_by_vendor(no_pre, no_post)) == [
        ("Antes", "V1", 2), ("Después", "V1", 1),
    ]
    assert mrp.no_req_listing(no_pre).columns == ["item", "vendor"]


def test_mrp_options(runs):
    got = unordered(mrp.filter_options(*runs, "RAW", "X", "1"))
    values = {name: [v for n, v in got if n == name] for name in {n for n, _ in got}}
    assert values["type"] == ["PKG", "RAW"]
    assert values["vendor"] == ["X"]
    assert values["po"] == ["1", "2", "4", "Sin P/O"]
    assert values["item"] == ["A", "B"]
    assert values["date_min"] == ["2024-11-01"] and values["date_max"] == ["2025-03-01"]
    every = unordered(mrp.filter_options(*runs))
    assert [v for n, v in every if n == "vendor"] == ["Sin Vendor", "X", "Y"]


@pytest.fixture(scope="module")
def amounts(spark):
    forecast = [
        (at(2025, 1, 1), "a", "i1", 100.0),
        (at(2025, 1, 31), "b", "i1", 50.0),
        (at(2025, 5, 1), "a", "i2", 70.0),
        (None, "c", "i1", 1.0),
        (at(2025, 4, 7), None, "i1", 2.0),
    ]
    sold = [
        (at(2025, 1, 6), "a", "i1", 80.0),
        (at(2025, 3, 3), "d", "i3", 30.0),
        (at(2025, 3, 4), "d", "i3", None),
    ]
    return (
        spark.createDataFrame(
            forecast, "ship_on TIMESTAMP_NTZ, customer STRING, item STRING, amount DOUBLE"
        ),
        spark.createDataFrame(
            sold, "invoice_date TIMESTAMP_NTZ, customer STRING, item STRING, amount DOUBLE"
        ),
    )


def test_sales_grid(amounts):
    got = sales.grid(*amounts, "month")
    assert got.count() == 4 * 4
    cells = {(r.period.month, r.customer): (r.forecast, r.sold, r.difference) for r in got.collect()}
    assert cells[(1, "a")] == (100.0, 80.0, -20.0)
    assert cells[(4, "a")] == cells[(1, "c")] == (0.0, 0.0, 0.0)
    assert cells[(3, "d")] == (0.0, 30.0, 30.0)
    assert sum(c[1] for c in cells.values()) == 110.0
    assert rows(sales.totals(*amounts)) == [(223.0, 110.0)]


def test_sales_rankings(amounts):
    _, sold = amounts
    assert rows(sales.top_customers(sold, 5)) == [("a", 80.0), ("d", 30.0)]
    assert rows(sales.bottom_customers(sold, 1)) == [("d", 30.0)]
    assert rows(sales.top_customers(sold, 5, dt.date(2025, 3, 3), "week")) == [("d", 30.0)]
    assert rows(sales.top_customers(sold, 5, dt.date(2025, 1, 1))) == [("a", 80.0)]


def test_forecast_is_capped_at_the_last_sale(amounts):
    assert rows(sales.by_customer(*amounts)) == [
        ("b", 50.0, 0.0), ("d", 0.0, 30.0), ("a", 100.0, 80.0),
    ]
    assert rows(sales.by_customer(*amounts, dt.date(2025, 5, 1))) == [("a", 70.0, 0.0)]
    assert rows(sales.by_customer(*amounts, customers=["d"])) == [("d", 0.0, 30.0)]
    assert sales.by_customer(*amounts, customers=[]).count() == 3


def test_months_without_data_are_filled(amounts):
    got = [(r.period.month, r.forecast, r.sold) for r in sales.by_month(*amounts).collect()]
    assert got == [(1, 150.0, 80.0), (2, 0.0, 0.0), (3, 0.0, 30.0), (4, 2.0, 0.0), (5, 70.0, 0.0)]


def test_customer_views(amounts):
    series = sales.customer_series(*amounts, "a", "month")
    assert unordered(series.select("period", "kind", "amount")) == [
        (dt.date(2025, 1, 1), "forecast", 100.0),
        (dt.date(2025, 1, 1), "sold", 80.0),
        (dt.date(2025, 5, 1), "forecast", 70.0),
        (dt.date(2025, 5, 1), "sold", 0.0),
    ]
    detail = sales.item_detail(*amounts, "a", dt.date(2025, 1, 1))
    assert rows(detail) == [("i1", 100.0, 80.0, -20.0)]
    assert sales.item_detail_long(detail).count() == 2
    assert [r[0] for r in rows(sales.customers(*amounts))] == ["a", "b", "c", "d"]
    periods = rows(sales.periods(amounts[1], "week"))
    assert [p[0] for p in periods] == [dt.date(2025, 1, 6), dt.date(2025, 3, 3)]


def test_sales_ladder(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2025, 1, 1), 1.0), ("b", dt.date(2025, 3, 15), 2.0), (None, None, 4.0)],
        "customer STRING, month DATE, amount DOUBLE",
    )
    assert unordered(sales.ladder_by_customer(df)) == [("a", 1.0), ("b", 2.0)]
    assert sales.ladder_by_customer(df, []).count() == 0
    got = [(r.label, r.amount) for r in sales.ladder_by_month(df).collect()]
    assert got == [("Jan-2025", 1.0), ("Feb-2025", 0.0), ("Mar-2025", 2.0)]


def test_platform(spark):
    df = spark.createDataFrame(
        [
            ("p1", "s1", at(2025, 1, 1), 1.0, 10.0),
            ("p1", "s2", at(2025, 1, 5), 2.0, 30.0),
            ("p2", "s1", at(2025, 2, 1), 1.0, 60.0),
            (None, "s3", at(2025, 2, 1), 9.0, 9.0),
        ],
        "platform STRING, ship_to STRING, wanted_on TIMESTAMP_NTZ, quantity DOUBLE, amount DOUBLE",
    )
    assert unordered(platform.by_platform(df)) == [("p1", 3.0, 40.0), ("p2", 1.0, 60.0)]
    assert unordered(platform.platform_share(df)) == [
        ("p1", 3.0, 40.0, 0.75, 0.4), ("p2", 1.0, 60.0, 0.25, 0.6),
    ]
    assert unordered(platform.by_ship_to(df))[0] == ("s1", 2.0, 70.0)
    assert platform.filter_platform_orders(df, [], []).count() == 4
    assert platform.filter_platform_orders(df, ["p1"], ["s1", "s3"]).count() == 1
    options = unordered(platform.platform_options(df, ["p1"]))
    assert options == [
        ("date_max", "2025-01-05"), ("date_min", "2025-01-01"),
        ("platform", "p1"), ("platform", "p2"), ("ship_to", "s1"), ("ship_to", "s2"),
    ]


@pytest.fixture(scope="module")
def purchases(spark):
    return spark.createDataFrame(
        [
            ("RAW", "v1", "1", at(2024, 12, 5), 1.0, 10.0),
            ("RAW", "v1", "2", at(2025, 2, 5, 9), 2.0, 20.0),
            ("PKG", "v2", "3", at(2025, 2, 5), 4.0, 40.0),
            ("TOTAL", "v2", "3", at(2025, 2, 6), 8.0, 80.0),
            (None, None, None, None, 16.0, None),
        ],
        "type STRING, vendor STRING, po STRING, wanted_on TIMESTAMP_NTZ, quantity DOUBLE, total DOUBLE",
    )


def test_purchase_tables(purchases):
    assert rows(purchasing.purchase_totals(purchases)) == [(150.0, 31.0)]
    assert unordered(purchasing.by_vendor(purchases)) == [("v1", 30.0, 3.0), ("v2", 120.0, 12.0)]
    assert rows(purchasing.by_day(purchases)) == [
        (dt.date(2024, 12, 5), 10.0, 1.0),
        (dt.date(2025, 2, 5), 60.0, 6.0),
        (dt.date(2025, 2, 6), 80.0, 8.0),
    ]
    assert purchasing.filter_purchases(purchases, vendors=[]).count() == 0
    assert purchasing.filter_purchases(purchases, vendors=["v2"], types=["PKG"]).count() == 1
    options = unordered(purchasing.purchase_options(purchases, ["RAW"], [], ["2"]))
    assert [v for n, v in options if n == "vendor"] == ["v1"]
    assert [v for n, v in options if n == "po"] == ["1", "2"]
    assert ("date_min", "2025-02-05") in options


def test_purchase_calendar(purchases):
    long = purchasing.calendar(purchases)
    # Three types and the totals, two years of twelve months.
    assert long.count() == 4 * 24
    total = long.where("is_total").groupBy("year").agg(F.sum("quantity")).orderBy("year")
    assert rows(total) == [(2024, 1.0), (2025, 14.0)]
    wide = purchasing.calendar_wide(purchases, [2024, 2025])
    assert len(wide.columns) == 25
    by_type = [(r["type"], r["2024-12"], r["2025-02"], r["2025-03"]) for r in wide.collect()]
    assert sorted(by_type) == [
        ("PKG", 0.0, 4.0, 0.0), ("RAW", 1.0, 2.0, 0.0), ("TOTAL", 0.0, 8.0, 0.0),
        ("TOTAL", 1.0, 14.0, 0.0),
    ]
    assert purchasing.calendar(purchases, years=[2025], types=["RAW"]).count() == 2 * 12


def test_month_type_series(purchases):
    got = purchasing.month_type_series(purchases)
    assert got.count() == 3 * 3
    assert got.agg(F.sum("quantity")).first()[0] == 15.0


def test_plan_ladder(spark):
    d1, d2 = dt.date(2025, 7, 1), dt.date(2025, 7, 8)
    long = spark.createDataFrame(
        [
            ("i", "Archivo_1", d1, None, 1),
            ("i", "Archivo_1", d1, 5.0, 3),
            ("i", "Archivo_1", d1, 6.0, 2),
            ("i", "Archivo_2", d2, 7.0, 1),
            ("k", "Archivo_2", d2, None, 2),
        ],
        "item STRING, snapshot STRING, plan_date DATE, qty DOUBLE, row_no BIGINT",
    )
    assert unordered(ladder.ladder_table(long, [d2, d1])) == [
        ("i", "Archivo_1", 6.0, None, ""), ("i", "Archivo_2", None, 7.0, ""),
    ]
    assert rows(ladder.item_series(long, "i")) == [("Archivo_1", d1, 6.0), ("Archivo_2", d2, 7.0)]
    assert rows(ladder.ladder_items(long)) == [("i",)]
    assert rows(ladder.ladder_dates(long)) == [(d1,), (d2,)]


def test_pages(spark, runs, amounts, purchases):
    pre, post = runs
    none = spark.createDataFrame([("A", "RAW", "V")], "item STRING, type STRING, vendor STRING")
    tables = [MrpTables(r.drop("po_number", "vendor"), none) for r in runs]
    assert "comparison" not in pages.mrp_page(*tables)
    page = pages.mrp_page(*tables, "RAW", "X", "1", as_of=dt.date(2025, 2, 1))
    assert page["comparison"].count() == 2 and page["overdue"].count() == 1
    assert page["requirement_lost"].count() == 0

    page = pages.sales_page(*amounts, grain="month", period=dt.date(2025, 1, 1), customer="a")
    assert page["item_detail"].count() == 1 and page["by_customer"].count() == 2
    assert "item_detail" not in pages.sales_page(*amounts)

    page = pages.purchase_page(purchases, types=["RAW"], years=[2025])
    assert page["calendar"].count() == 24 and rows(page["totals"]) == [(30.0, 3.0)]


def test_production_page(spark, cards):
    full = cards.withColumn("hours", F.lit(1.0)).withColumns(
        {c: F.lit(2.0) for c in ("expected_run_rate", "actual_run_rate")}
    )
    stops = spark.createDataFrame([("P1", 1.0, "D001")], "wc STRING, downtime_h DOUBLE, reason_id STRING")
    dim = spark.createDataFrame([("D001", "x")], "reason_id STRING, description STRING")
    page = pages.production_page(full, stops, dim, shifts=["A"], wcs=["P1"], order=["row_no"])
    # The indicators are taken before the work-centre choice, the rest after it.
    assert rows(page["kpis"]) == [(85.0, 60.0, 10.0, 0.5)]
    assert rows(page["hours_by_wc"]) == [("P1", 1.0)]
    assert page["downtime_by_reason"].count() == 1
    options = rows(page["options"])
    assert [v for n, v in options if n == "wc_type"] == ["PRESS"]
    assert sorted(v for n, v in options if n == "shift") == ["A", "B"]
    foreign = stops.unionByName(stops.withColumns({"wc": F.lit("Z9"), "downtime_h": F.lit(9.0)}))
    page = pages.production_page(full, foreign, shifts=["A"], order=["row_no"])
    assert "Z9" not in [r.wc for r in page["downtime_by_wc"].collect()]
    page = pages.production_page(full, stops, dim, shifts=["A"], wcs=["P1"], order=["row_no"])
    assert len(page) == 17 and len(pages.production_page(full, order=["row_no"])) == 15
    assert production.repeated_reasons(dim).count() == 0
    assert production.repeated_reasons(dim.unionByName(dim)).count() == 1
