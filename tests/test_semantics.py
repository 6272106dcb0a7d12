"""One small literal table per rule that differs between the reports and plain Spark."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopledger.functions import (
    clean_cell,
    clean_header,
    code_part,
    exact_mean,
    exact_sum,
    integer_text,
    money_text,
    month_label,
    month_name,
    number_text,
    percent_or_zero,
    period_label,
    period_start,
    po_number,
    rint_to,
    strip_ws,
    to_number,
    to_time,
    vendor_name,
    week_start,
    whole_days,
)
from shopledger.operators import by_key, date_range, equal_to, in_list, keep_first, top_k
from tests.conftest import rows


def values(spark, column, texts, name="c STRING"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i INT, {name}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_bad_numbers_become_null(spark):
    texts = ["12", " 3.5\t", "-1e3", "", "abc", "1,000", "1d", "0x1p3", "NaN", "Infinity", None]
    expected = [12.0, 3.5, -1000.0] + [None] * 8
    assert values(spark, to_number(F.col("c")), texts) == expected


def test_bad_dates_become_null(spark):
    texts = ["2025-07-01", "2025-07-01 10:20", "2025-07-01 10:20:30", "2025-13-01", "x", None]
    expected = [
        dt.datetime(2025, 7, 1),
        dt.datetime(2025, 7, 1, 10, 20),
        dt.datetime(2025, 7, 1, 10, 20, 30),
        None,
        None,
        None,
    ]
    assert values(spark, to_time(F.col("c")), texts) == expected


def test_day_first_format(spark):
    got = values(spark, to_time(F.col("c"), ["dd/MM/yyyy"]), ["01/07/2025", "2025-07-01"])
    assert got == [dt.datetime(2025, 7, 1), None]


def test_clock_times_do_not_depend_on_the_session_zone(spark):
    texts = ["2025-03-09 02:30", "2025-11-02 01:30", "2025-07-01T08:00:00"]
    expected = [dt.datetime(2025, 3, 9, 2, 30), dt.datetime(2025, 11, 2, 1, 30), dt.datetime(2025, 7, 1, 8)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, to_time(F.col("c")), texts) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_null_keys_are_dropped_and_empty_groups_sum_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 5.0)], "k STRING, x DOUBLE")
    assert rows(by_key(df, "k", "x", "sum")) == [("b", 0.0), ("a", 1.0)]
    assert rows(by_key(df, "k", "x", "avg")) == [("a", 1.0), ("b", None)]
    assert rows(by_key(df, "k", "x", "avg", descending=True)) == [("a", 1.0), ("b", None)]


def test_distinct_ignores_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x")], "k STRING, v STRING")
    assert rows(by_key(df, "k", "v", "distinct")) == [("a", 1)]


def test_ties_are_broken_by_key(spark):
    df = spark.createDataFrame([(k, 1.0) for k in "cabfed"], "k STRING, x DOUBLE")
    assert [r[0] for r in rows(top_k(df, "k", "x", "sum", 3, descending=True))] == ["a", "b", "c"]


def test_keep_first_follows_row_order_and_merges_null_keys(spark):
    data = [("t1", 2, "b"), ("t1", 1, "a"), (None, 4, "d"), (None, 3, "c")]
    df = spark.createDataFrame(data, "sheet STRING, row_no INT, v STRING")
    got = keep_first(df, ["sheet"], ["row_no"]).orderBy("row_no")
    assert rows(got) == [("t1", 1, "a"), (None, 3, "c")]


def test_division_by_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (1.0, 3.0)], "p DOUBLE, w DOUBLE")
    got = rows(df.select(percent_or_zero(F.col("p"), F.col("w"))))
    assert got == [(0.0,), (None,), (33.33,)]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    df = spark.createDataFrame([(0.125,), (2.345,), (-0.125,)], "x DOUBLE")
    assert rows(df.select(rint_to(F.col("x"), 2))) == [(0.12,), (2.35,), (-0.12,)]


def test_whole_days_are_floored_elapsed_time(spark):
    a, b = dt.datetime(2025, 1, 8), dt.datetime(2025, 1, 6, 10)
    df = spark.createDataFrame([(a, b)], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    got = rows(df.select(whole_days(F.col("a"), F.col("b")), whole_days(F.col("b"), F.col("a"))))
    assert got == [(1, -2)]


def test_week_and_month_starts(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 5, 12),)], "d TIMESTAMP_NTZ")
    got = df.select(week_start(F.col("d")), period_start(F.col("d"), "month"))
    assert rows(got) == [(dt.date(2024, 12, 30), dt.date(2025, 1, 1))]
    with pytest.raises(ValueError):
        period_start(F.col("d"), "year")


def test_week_labels_match_strftime(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * i + i % 7) for i in range(300)]
    df = spark.createDataFrame([(d,) for d in days], "d DATE")
    got = df.select("d", period_label(F.col("d"), "week"))
    assert all(label == d.strftime("Semana %U (%d-%b)") for d, label in rows(got))


def test_month_labels(spark):
    df = spark.createDataFrame([(dt.date(2025, 3, 9),)], "d DATE")
    d = F.col("d")
    got = df.select(month_label(d), month_name(d), period_label(d, "month"))
    assert rows(got) == [("Mar-2025", "March", "March 2025")]


def test_upper_bound_is_midnight_unless_asked(spark):
    times = [dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2), dt.datetime(2025, 1, 2, 15)]
    df = spark.createDataFrame([(t,) for t in times], "t TIMESTAMP_NTZ")
    span = (dt.date(2025, 1, 1), dt.date(2025, 1, 2))
    assert date_range(df, "t", span).count() == 2
    assert date_range(df, "t", span, end_of_day=True).count() == 3
    assert date_range(df, "t", None).count() == 3


def test_empty_selection_modes(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k STRING")
    assert in_list(df, "k", []).count() == 0
    assert in_list(df, "k", [], empty="all").count() == 3
    assert in_list(df, "k", None).count() == 3
    assert in_list(df, "k", ["a"]).count() == 1
    assert in_list(df, "k", spark.createDataFrame([("b",)], "other STRING")).count() == 1
    with pytest.raises(ValueError):
        in_list(df, "k", ["a"], empty="some")


def test_equality_choices(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k STRING, n INT")
    assert equal_to(df, {"k": "Todos", "n": None}).count() == 2
    assert equal_to(df, {"k": "a", "n": 1}).count() == 1


def test_strip_removes_all_whitespace(spark):
    assert values(spark, strip_ws(F.col("c")), ["\t a b\r\n", " x "]) == ["a b", "x"]


def test_null_tokens(spark):
    texts = [" - ", "N/A", "nan", "None", "NaT", "na", "", None]
    expected = [None] * 5 + ["na", "", None]
    assert values(spark, clean_cell(F.col("c")), texts) == expected


def test_header_cleaning(spark):
    assert values(spark, clean_header(F.col("c")), [" Job\n  # ", "W/C"]) == ["Job #", "W/C"]


def test_exact_sum_is_independent_of_order(spark):
    data = [(x,) for x in [1e9 + 0.1, 0.2, -1e9, 0.3, 1e12, -1e12, 0.0001] * 50]
    df = spark.createDataFrame(data, "x DOUBLE")
    sums = {
        df.repartition(n).agg(exact_sum(F.col("x"))).first()[0] for n in (1, 3, 7, 16)
    }
    assert sums == {30.005}


def test_exact_mean(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x DOUBLE")
    assert df.agg(exact_mean(F.col("x"))).first()[0] == 1.5
    assert df.where("x IS NULL").agg(exact_mean(F.col("x"))).first()[0] is None


def test_vendor_and_order_number(spark):
    texts = [
        "Vendor , ACME Inc , P/O # 123 , open",
        "Vendor ACME Vendor B",
        "P/O # 9",
        "nothing",
        None,
    ]
    assert values(spark, vendor_name(F.col("c")), texts) == [
        "ACME Inc", "ACME", "Sin Vendor", "Sin Vendor", "Sin Vendor",
    ]
    assert values(spark, po_number(F.col("c")), texts) == [
        "123", "Sin P/O", "9", "Sin P/O", "Sin P/O",
    ]


def test_code_part(spark):
    assert values(spark, code_part(F.col("c")), ["D005 - x - y", "PRESS01"]) == ["D005", "PRESS01"]


def test_display_text(spark):
    df = spark.createDataFrame([(1234567.125, 2.5)], "a DOUBLE, b DOUBLE")
    a, b = F.col("a"), F.col("b")
    got = df.select(money_text(a), number_text(b), integer_text(b))
    assert rows(got) == [("$1,234,567.12", "2", "2")]


def test_fractions_of_seconds_are_read(spark):
    got = values(spark, to_time(F.col("c")), ["2025-01-01 10:30:00.500", "2025-01-01T10:30:00.25"])
    assert [t.microsecond for t in got] == [500000, 250000]


def test_sums_keep_all_decimals_and_skip_nan(spark):
    df = spark.createDataFrame([(0.00004,), (0.00004,), (0.00004,), (float("nan"),), (None,)], "x double")
    got = df.agg(exact_sum(F.col("x")).alias("s"), exact_mean(F.col("x")).alias("m")).first()
    assert abs(got.s - 0.00012) < 1e-18 and abs(got.m - 0.00004) < 1e-18
    big = spark.createDataFrame([(1e18,), (2.5,), (1e18,)], "x double")
    assert big.agg(exact_sum(F.col("x"))).first()[0] == 2e18
