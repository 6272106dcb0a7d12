from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopledger.operators import (
    dense_fill,
    fill_months,
    forward_fill,
    keys_only_in_first,
    month_spine,
    number_rows,
    observed,
    option_rows,
    share_of_total,
    side_by_side,
)
from shopledger.operators.ordered import join_per_group
from tests.conftest import rows, unordered

FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
CELLS = st.lists(
    st.tuples(st.sampled_from(["f1", "f2"]), st.one_of(st.none(), st.sampled_from("xyz"))),
    min_size=1,
    max_size=40,
)


@FEW
@given(cells=CELLS, bucket=st.integers(1, 9))
def test_forward_fill_in_buckets_equals_brute_force(spark, cells, bucket):
    data = [(f, 3 * i, v) for i, (f, v) in enumerate(cells)]
    df = spark.createDataFrame(data, "file STRING, row_no BIGINT, v STRING")
    last: dict[str, str | None] = {}
    expected = []
    for f, i, v in data:
        last[f] = v if v is not None else last.get(f)
        expected.append((f, i, last[f]))
    assert unordered(forward_fill(df, "v", bucket_rows=bucket)) == sorted(expected, key=repr)
    assert unordered(forward_fill(df, "v", bucket_rows=None)) == sorted(expected, key=repr)


def test_forward_fill_carries_over_many_empty_buckets(spark):
    df = spark.range(1000).select(
        F.lit("f").alias("file"),
        F.col("id").alias("row_no"),
        F.when(F.col("id") == 3, F.struct(F.lit("a").alias("x"), F.lit(None).alias("y"))).alias("v"),
    )
    got = forward_fill(df, "v", bucket_rows=10).where("row_no >= 3")
    assert got.where("v.x = 'a' AND v.y IS NULL").count() == 997


def test_forward_fill_reads_its_input_once(spark, tmp_path):
    """The rows are scanned and shuffled once, although they are filled and summed up."""
    spark.range(5000).select(
        F.lit("f").alias("file"), F.col("id").alias("row_no"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"), "id"
    ).write.parquet(str(tmp_path / "t"))
    df = forward_fill(spark.read.parquet(str(tmp_path / "t")), "v", bucket_rows=64)
    assert df.where("row_no >= 3 AND v = row_no - (row_no - 3) % 700").count() == 4997
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_number_rows_is_dense_and_ordered(spark):
    data = [(f, c, n) for f in "ab" for c in (2, 1, 5) for n in (9, 7, 8)]
    df = spark.createDataFrame(data, "file STRING, chunk INT, n INT")
    got = number_rows(df, by=["file"], chunk=["chunk"], order=["n"])
    for f in "ab":
        mine = sorted((r, c, n) for g, c, n, r in rows(got) if g == f)
        assert [r for r, _, _ in mine] == list(range(1, 10))
        assert [(c, n) for _, c, n in mine] == sorted((c, n) for _, c, n in mine)


def test_join_per_group_reaches_every_block(spark):
    big = spark.range(20000).select(F.lit("f").alias("file"), F.col("id").alias("row_no"))
    other = spark.range(5).select(F.lit("g").alias("file"), F.col("id").alias("row_no"))
    info = spark.createDataFrame([("f", 7)], "file STRING, x INT")
    got = join_per_group(big.unionByName(other), info)
    assert got.where("x = 7").count() == got.count() == 20000


@FEW
@given(
    left=st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(-5, 5)), max_size=8),
    right=st.lists(st.tuples(st.sampled_from(["b", "c", "d"]), st.integers(-5, 5)), max_size=8),
)
def test_side_by_side_equals_outer_join_of_sums(spark, left, right):
    schema = "k STRING, x DOUBLE"
    tables = [
        spark.createDataFrame([(k, float(x)) for k, x in t], schema) for t in (left, right)
    ]
    got = side_by_side({"l": (tables[0], "x"), "r": (tables[1], "x")}, ["k"])
    keys = {k for k, _ in left + right if k is not None}
    expected = [
        (k, float(sum(x for j, x in left if j == k)), float(sum(x for j, x in right if j == k)))
        for k in keys
    ]
    assert unordered(got) == sorted(expected, key=repr)


def test_keys_only_in_first(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k STRING")
    b = spark.createDataFrame([("x",), ("z",)], "k STRING")
    assert rows(keys_only_in_first(a, b, "k")) == [("y",)]
    assert rows(keys_only_in_first(b, a, "k")) == [("z",)]
    assert rows(keys_only_in_first(a, a, "k")) == []


def test_dense_fill_and_spine(spark):
    jan, mar = dt.date(2025, 1, 1), dt.date(2025, 3, 1)
    data = [("a", jan, 1.0), ("b", mar, 2.0), ("c", None, 9.0)]
    df = spark.createDataFrame(data, "k STRING, m DATE, x DOUBLE")
    grid = dense_fill(df, ["k"], "m", ["x"], month_spine(df, F.col("m")))
    assert grid.count() == 9
    filled = {(r[0].month, r[1]): r[2] for r in rows(grid)}
    assert filled[(1, "a")] == 1.0 and filled[(3, "b")] == 2.0
    assert sum(filled.values()) == 3.0
    seen = dense_fill(df, ["k"], "m", ["x"], observed(df, "m"))
    assert {r[0] for r in rows(seen)} == {jan, mar} and seen.count() == 6


def test_spine_over_no_rows_is_empty(spark):
    df = spark.createDataFrame([], "k STRING, m DATE, x DOUBLE")
    assert dense_fill(df, ["k"], "m", ["x"], month_spine(df, F.col("m"))).count() == 0


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k STRING, x DOUBLE")
    assert unordered(share_of_total(df, {"x": "s"})) == [("a", 1.0, 0.25), ("b", 3.0, 0.75)]
    zero = spark.createDataFrame([("a", 0.0)], "k STRING, x DOUBLE")
    assert rows(share_of_total(zero, {"x": "s"})) == [("a", 0.0, None)]


def test_option_rows(spark):
    data = [
        ("p1", "s1", dt.datetime(2025, 1, 2, 5)),
        ("p2", "s2", dt.datetime(2025, 3, 1)),
        ("p1", None, None),
        (None, "s1", dt.datetime(2024, 1, 1)),
    ]
    df = spark.createDataFrame(data, "p STRING, s STRING, t TIMESTAMP_NTZ")
    chosen = F.coalesce(F.col("p") == "p1", F.lit(False))
    got = option_rows(df, {"p": ("p", F.lit(True)), "s": ("s", chosen)}, ("t", chosen))
    assert unordered(got) == [
        ("date_max", "2025-01-02"),
        ("date_min", "2025-01-02"),
        ("p", "p1"),
        ("p", "p2"),
        ("s", "s1"),
    ]


def test_fill_months(spark):
    data = [(dt.date(2024, 11, 1), 1.0), (dt.date(2025, 2, 1), 2.0)]
    df = spark.createDataFrame(data, "m DATE, x DOUBLE")
    got = sorted(rows(fill_months(df, "m", ["x"])))
    assert [x for _, x in got] == [1.0, 0.0, 0.0, 2.0]
    assert [m.month for m, _ in got] == [11, 12, 1, 2]
    assert fill_months(df.where("x > 9"), "m", ["x"]).count() == 0
