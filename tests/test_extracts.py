"""CSV extracts are written and landed in slices."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from checks import extracts
from checks.queries import queries
from checks.tables import _LANDED, Tables
from shopledger.session import shared_folder
from tests.conftest import unordered

NAMES = ("load_timecards", "load_timecards_rejects", "load_strict_timecards")
#: Three reports. Lines and orders come twice, and some have nulls.
ORDERS = [o for o in range(400) if o % 8 < 3]
#: Order, part, supplier and number of each line.
LINES = [(o, (o * 7 + k) % 40, (o + k) % 6, k % 7 + 1) for o in ORDERS for k in range(3)]
LINES += [*LINES[:9], (None, 1, 1, 1), (8, None, 1, 2), (8, 1, None, 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    day = dt.datetime(1996, 3, 1)
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", n % 2) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(c, f"C{c}", c % 3, 1.0, "MACHINERY") for c in range(9)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(s, f"S {s}", s % 3, 1.0) for s in range(6)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(p, "a", "b", "c", 1, 900.0 + p) for p in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": (
            [(o, o % 9 if o % 3 else None, "O", 1.0, day, "1") for o in [*ORDERS, 16]],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (
            [(*x, 5.0 + (x[0] or 0) % 7, 100.0, 0.04, 0.02, "A", "F", day + dt.timedelta(days=(x[0] or 0) % 900)) for x in LINES],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
    }
    for name, (given, schema) in tables.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def texts_left(spark) -> set[str]:
    """Text files with anything in them below the shared folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(shared_folder(spark))
    return {r.path for r in found.where(F.col("length") > 0).select("path").collect()}


def test_slices_give_the_same_rows_and_leave_no_text(spark, folder, monkeypatch):
    monkeypatch.setattr(extracts, "SLICES", 4)
    got, before = [], texts_left(spark)
    for rows in (1 << 20, 1):  # one slice, and more than there are reports
        monkeypatch.setattr(extracts, "SLICE_ROWS", rows)
        _LANDED.clear()
        got.append({name: unordered(queries()[name](spark, folder)) for name in NAMES})
        files = [r.file for r in extracts.timecards(Tables(spark, folder)).select("file").distinct().collect()]
        assert sorted(re.search(r"report=(\d+)/", f).group(1) for f in files) == ["0", "1", "2"]
        assert texts_left(spark) == before
    _LANDED.clear()
    assert got[0] == got[1] and all(got[0][name] for name in NAMES)
    assert len(got[0]["load_strict_timecards"]) > 90 and got[0]["load_timecards_rejects"] == [(2, "Quantity, OEE", "missing columns")]
