"""The driver tables seen as report tables.

One text serves both engines: ``{table}`` placeholders become DataFrames in Spark
and plain names in DuckDB. A view joins only what the requested columns need; the
SQL twins always use the full view, so a wrong shortcut would show up.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

def _num(x: str) -> str:
    """A value with four decimals, so that both engines add up the same exact numbers."""
    return f"(floor(({x}) * 10000 + 0.5) / 10000)"


# alias prefix -> (join, tables it builds on)
JOINS = {
    "o": ("JOIN {orders} o ON o.o_orderkey = l.l_orderkey", ""),
    "c": ("JOIN {customer} c ON c.c_custkey = o.o_custkey", "o"),
    "cn": ("JOIN {nation} cn ON cn.n_nationkey = c.c_nationkey", "c"),
    "p": ("JOIN {part} p ON p.p_partkey = l.l_partkey", ""),
    "s": ("JOIN {supplier} s ON s.s_suppkey = l.l_suppkey", ""),
    "n": ("JOIN {nation} n ON n.n_nationkey = s.s_nationkey", "s"),
    "r": ("JOIN {region} r ON r.r_regionkey = n.n_regionkey", "n"),
}


@dataclass(frozen=True)
class View:
    columns: dict[str, str]
    extra: dict[str, str] = field(default_factory=dict)

    def sql(self, columns: Sequence[str] | None = None) -> str:
        """SELECT text of the view; a column list restricts it and drops unneeded joins."""
        texts = {**self.columns, **self.extra}
        chosen = texts if columns is None else {c: texts[c] for c in columns}
        body = " ".join(chosen.values())
        needed = {a for a in JOINS if columns is None or re.search(rf"\b{a}\.", body)}
        for alias in ("r", "n", "cn", "c"):
            if alias in needed and JOINS[alias][1]:
                needed.add(JOINS[alias][1])
        joins = " ".join(text for alias, (text, _) in JOINS.items() if alias in needed)
        select = ", ".join(f"{text} AS {name}" for name, text in chosen.items())
        return f"SELECT {select} FROM {{lineitem}} l {joins}"


# The row order inside a timesheet.
LINE_ORDER = {
    "line_1": "l.l_linenumber",
    "line_2": "l.l_partkey",
    "line_3": "l.l_suppkey",
    "line_4": "l.l_shipdate",
}

REASON = "concat('D', lpad(CAST(1 + l.l_partkey % 73 AS STRING), 3, '0'))"

TIMECARDS = View(
    {
        "wc_type": "r.r_name",
        "wc": "s.s_name",
        "shift": "l.l_returnflag",
        "completed_on": "l.l_shipdate",
        "timesheet_no": "CAST(l.l_orderkey AS STRING)",
        "job_no": "CAST(l.l_partkey AS STRING)",
        "employee": "CAST(o.o_custkey AS STRING)",
        "expected_run_rate": "p.p_retailprice",
        "actual_run_rate": _num("l.l_extendedprice / l.l_quantity"),
        "quantity": "l.l_quantity",
        "scrap": _num("l.l_quantity * l.l_tax"),
        "hours": "l.l_quantity / 10",
        "efficiency": _num("100 * (1 - l.l_discount)"),
        "oee": _num("100 * (1 - l.l_discount) * (1 - l.l_tax)"),
        "prod_downtime_h": _num("10 * l.l_discount"),
        "nonprod_downtime_h": _num("10 * l.l_tax"),
        "reason_id": REASON,
    },
    extra=LINE_ORDER,
)

DOWNTIME = View({"wc": "s.s_name", "downtime_h": _num("10 * l.l_discount"), "reason_id": REASON})

PRODUCED = (
    "CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity "
    "ELSE CAST(floor(l.l_quantity * (1 - 5 * l.l_discount)) AS DOUBLE) END"
)

SCHEDULED_JOBS = View(
    {
        "wc_type": "r.r_name",
        "wc": "s.s_name",
        "job_no": "CAST(l.l_orderkey AS STRING)",
        "item": "CAST(l.l_partkey AS STRING)",
        "to_make": "l.l_quantity",
        "produced": PRODUCED,
        "remaining": f"l.l_quantity - ({PRODUCED})",
        "can_make": "CAST(floor(l.l_quantity * 0.9) AS DOUBLE)",
    }
)

# Machinery is invoiced under its own customer names, so it has no forecast.
SALES = View(
    {
        "invoice_date": "l.l_shipdate",
        "customer": (
            "CASE WHEN c.c_mktsegment = 'MACHINERY' THEN concat(c.c_name, ' direct') ELSE c.c_name END"
        ),
        "item": "CAST(l.l_partkey AS STRING)",
        "amount": _num("l.l_extendedprice * (1 - l.l_discount)"),
    },
    extra={"segment": "c.c_mktsegment"},
)

# Households are forecast under their own names, and what is due in July is planned for August.
FORECAST = View(
    {
        "ship_on": (
            "CASE WHEN month(o.o_orderdate) = 7 THEN o.o_orderdate + INTERVAL '31' DAY "
            "ELSE o.o_orderdate END"
        ),
        "customer": (
            "CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN concat(c.c_name, ' stock') ELSE c.c_name END"
        ),
        "item": "CAST(l.l_partkey AS STRING)",
        "amount": "l.l_extendedprice",
    },
    extra={"segment": "c.c_mktsegment"},
)

PLATFORM_ORDERS = View(
    {
        "platform": "c.c_mktsegment",
        "ship_to": "cn.n_name",
        "wanted_on": "o.o_orderdate",
        "quantity": "l.l_quantity",
        "amount": "l.l_extendedprice",
    }
)

PURCHASE_FORECAST = View(
    {
        "item": "CAST(l.l_partkey AS STRING)",
        "type": "p.p_type",
        "wanted_on": "l.l_shipdate",
        "quantity": "l.l_quantity",
        "vendor": "s.s_name",
        "po": "CAST(l.l_orderkey AS STRING)",
        "unit_price_mxn": "l.l_extendedprice / l.l_quantity",
        "total": "l.l_extendedprice",
    }
)

# Orders of one priority go by another number in each run, so each run has some the other lacks.
RENUMBERED = {"pre": "5-LOW", "post": "4-NOT SPECIFIED"}

MRP_PO = {
    run: View(
        {
            "item": "CAST(l.l_partkey AS STRING)",
            "type": "p.p_type",
            "arrival_date": "l.l_shipdate",
            "ship_date": "o.o_orderdate",
            "qty": "l.l_quantity",
            "vendor_po_text": (
                "concat('Vendor ', s.s_name, ', P/O # ', CASE WHEN o.o_orderpriority = "
                f"'{priority}' THEN '{run}-' ELSE '' END, CAST(l.l_orderkey AS STRING), ', open')"
            ),
        },
        extra={
            "part_key": "l.l_partkey",
            "order_key": "l.l_orderkey",
            "line_1": "l.l_linenumber",
            "line_2": "l.l_suppkey",
        },
    )
    for run, priority in RENUMBERED.items()
}

# Requirement text of an item: empty or 0 means none.
REQUIREMENT = {
    "pre": "CASE WHEN p_size <= 5 THEN NULL WHEN p_size <= 10 THEN '0' ELSE '5' END",
    "post": (
        "CASE WHEN p_size BETWEEN 5 AND 9 THEN NULL "
        "WHEN p_size BETWEEN 10 AND 14 THEN '0' ELSE '5' END"
    ),
}

ITEMS = (
    "SELECT CAST(p_partkey AS STRING) AS item, p_type AS type, "
    "concat('V', CAST(p_partkey % 20 AS STRING)) AS vendor, "
    "CAST(p_partkey % 13 AS DOUBLE) AS on_hand, CAST(p_partkey % 17 AS DOUBLE) AS demand_total, "
    "{requirement} AS requirement, p_partkey AS part_key FROM {{part}}"
)


def items_sql(run: str) -> str:
    return ITEMS.format(requirement=REQUIREMENT[run])


def no_req_sql(run: str) -> str:
    return (
        "SELECT item, type, vendor, on_hand, demand_total FROM "
        f"({items_sql(run)}) i WHERE requirement IS NULL OR requirement = '0'"
    )


REASONS_SQL = (
    "SELECT DISTINCT concat('D', lpad(CAST(1 + p_partkey % 73 AS STRING), 3, '0')) AS reason_id, "
    "concat('Reason ', CAST((p_partkey % 73) % 70 AS STRING)) AS description FROM {part}"
)

SALES_LADDER = View(
    {
        "item": "CAST(l.l_partkey AS STRING)",
        "lmx": "p.p_brand",
        "customer": "c.c_mktsegment",
        "unit_price": "p.p_retailprice",
        "on_date": "l.l_shipdate",
        "line_amount": "l.l_extendedprice",
        "part_key": "l.l_partkey",
    }
)

PLAN_LADDER = View(
    {
        "item": "CAST(l.l_partkey AS STRING)",
        "snapshot_no": "1 + l.l_linenumber % 3",
        "on_date": "l.l_shipdate",
        "line_qty": "l.l_quantity",
        "part_key": "l.l_partkey",
    }
)
