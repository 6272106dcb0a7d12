"""CSV extracts of the driver tables, as report systems would leave them, for the loader queries.

Spark writes each folder once: preamble lines, headers in differing orders, padded cells, null
tokens, texts that are no numbers or dates, blank rows, line breaks and delimiters in cells,
and reports that break their contract. The same rules stand below in SQL for the twins.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import views
from checks.tables import ROWS_PER_TASK, Tables, landed_once
from shopledger.session import emptied, shared_folder, shuffles_dropped
from shopledger.sources.cells import land_csv
from shopledger.sources.contracts import SCHEDULED_JOBS, TIMECARDS, Contract

REPORT = "CAST(l.l_orderkey % 8 + 8 * floor(l.l_orderkey / 4000) AS BIGINT)"
PART_ROWS = 1 << 13

# Extracts of so many lines are written and landed at once, in so many slices at most.
SLICE_ROWS = 1 << 20
SLICES = 16

AS_LEFT = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# What the cells hold, as text: padding, tokens and bad values included.
TEXTS = {
    "wc": "concat('  ', s.s_name, ' ')",
    "job_no": "CASE WHEN l.l_partkey % 10 = 0 THEN 'None' ELSE CAST(l.l_partkey AS STRING) END",
    "completed_on": (
        "CASE WHEN l.l_partkey % 9 = 0 THEN 'NaT' WHEN l.l_partkey % 11 = 0 THEN '1997-31-31' "
        "ELSE CAST(CAST(l.l_shipdate AS DATE) AS STRING) END"
    ),
    "scrap": (
        "CASE WHEN l.l_linenumber % 4 = 0 THEN ' - ' WHEN l.l_linenumber % 4 = 1 THEN 'a few' "
        "ELSE concat(CAST(CAST(l.l_quantity AS BIGINT) AS STRING), '.5') END"
    ),
    "downtime_notes": (
        "CASE WHEN l.l_suppkey % 3 = 0 THEN concat('see \"', s.s_name, '\", again', chr(10), chr(10), 'and ask') "
        "WHEN l.l_suppkey % 3 = 1 THEN 'N/A' ELSE 'plain' END"
    ),
}

# What a loader makes of them.
LOADED = views.View(
    {
        "report": REPORT,
        "wc_type": "r.r_name",
        "wc": "s.s_name",
        "timesheet_no": "CAST(l.l_orderkey AS STRING)",
        "job_no": "CASE WHEN l.l_partkey % 10 = 0 THEN NULL ELSE CAST(l.l_partkey AS STRING) END",
        "completed_on": (
            "CASE WHEN l.l_partkey % 9 = 0 OR l.l_partkey % 11 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END"
        ),
        "quantity": "l.l_quantity",
        "scrap": "CASE WHEN l.l_linenumber % 4 < 2 THEN NULL ELSE l.l_quantity + 0.5 END",
        "oee": views.TIMECARDS.columns["oee"],
        "downtime_notes": (
            "CASE WHEN l.l_suppkey % 3 = 0 THEN concat('see \"', s.s_name, '\", again', chr(10), chr(10), 'and ask') "
            "WHEN l.l_suppkey % 3 = 1 THEN NULL ELSE 'plain' END"
        ),
    }
)

LOADED_JOBS = views.View(
    {
        "report": REPORT,
        "wc": "s.s_name",
        "job_no": "CAST(l.l_orderkey AS STRING)",
        "item": "CAST(l.l_partkey AS STRING)",
        "due": "CAST(l.l_shipdate AS DATE)",
        "to_make": "l.l_quantity",
        "can_make": views.SCHEDULED_JOBS.columns["can_make"],
    }
)


def _filled(contract: Contract, known: Sequence[str]) -> list[Column]:
    return [F.col(f.name).cast("string") if f.name in known else F.lit(None).cast("string") for f in contract.fields]


def _line(cells: Sequence[Column]) -> Column:
    return F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), AS_LEFT)


def _header(names: Sequence[str]) -> Column:
    return _line([F.lit(n) for n in names])


def _written(lines: DataFrame, order: Sequence[str], parts: int, folders: Sequence[str] = ("report",)) -> str:
    """The folder of CSV files, one for each ``report``, its lines by ``kind`` and then as given."""
    target = f"{shared_folder(lines.sparkSession)}/extract-{uuid.uuid4().hex}"
    by = [*folders, "kind", *order]
    sheets = lines.repartition(parts, *folders).sortWithinPartitions(*by).select(*folders, F.col("line").alias("value"))
    with shuffles_dropped(lines.sparkSession):
        sheets.write.partitionBy(*folders).text(target)
    return target


def _raw(t: Tables, name: str, lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """The raw cells of a folder of CSV files, one for each report.

    The files, and the shuffles before them, take several times the room of the cells. So reports are
    written and landed a slice at a time, and the files of a slice go when its cells are there.
    """
    slices = min(SLICES, max(1, -(-t.base["lineitem"].count() // SLICE_ROWS)))
    parts = t.parts("lineitem", ROWS_PER_TASK * slices)
    targets = []
    for i in range(slices):
        source = _written(lines.where(f"pmod(xxhash64(report), {slices}) = {i}"), order, parts)
        targets.append(f"{source}-{name}")
        land_csv(t.spark, source, targets[-1])
        emptied(t.spark, source)
    return t.spark.read.parquet(*targets)


def report_no(column: str = "file") -> Column:
    return F.regexp_extract(column, r"report=(\d+)", 1).cast("bigint").alias("report")


def _added(rows: DataFrame, lines: dict[int, Column]) -> DataFrame:
    """Lines by kind for every report, before (below zero) or after its rows."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), line.alias("line")) for kind, line in lines.items()]))
    return rows.select("report").distinct().select("report", each.alias("e")).select("report", "e.kind", "e.line")


def _with(t: Tables, view: views.View, texts: dict[str, str]) -> DataFrame:
    columns = {**view.columns, **view.extra, **texts, **views.LINE_ORDER, "report": REPORT}
    return t.sql(views.View(columns).sql())


def timecards(t: Tables) -> DataFrame:
    """Raw cells of timecard reports; every fourth lacks two columns, others have them in another order."""

    def build() -> DataFrame:
        rows = _with(t, views.TIMECARDS, TEXTS)
        known = [f.name for f in TIMECARDS.fields if f.name in rows.columns]
        cells = dict(zip(TIMECARDS.headers, _filled(TIMECARDS, known)))
        names = TIMECARDS.headers
        turned = [*names[::-1], "Extra"]
        lacking = [n for n in names if n not in ("Quantity", "OEE")]
        broken = [n.replace("Completed On", "Completed\n  On ") for n in names]
        kind = F.col("report") % 4
        by_kind = lambda pick: F.when(kind == 1, pick(turned)).when(kind == 2, pick(lacking)).otherwise(pick(names))
        order = list(views.LINE_ORDER)
        body = rows.select(
            "report", F.lit(0).alias("kind"), F.col("timesheet_no").cast("bigint").alias("sheet"), *order,
            by_kind(lambda ns: _line([cells.get(n, F.lit("x")) for n in ns])).alias("line"),
        )
        blank = F.when(F.col("sheet") % 2 == 0, "- ,,N/A,nan").otherwise("   ")
        row = F.struct("line", "line_4")
        empty = F.struct(blank.alias("line"), F.lit(None).cast(rows.schema["line_4"].dataType).alias("line_4"))
        others = [c for c in body.columns if c not in ("line", "line_4")]
        both = body.select(*others, F.explode(F.when(F.col("line_1") == 1, F.array(row, empty)).otherwise(F.array(row))).alias("e"))
        head = F.when(kind == 3, _header(broken)).otherwise(by_kind(_header))
        around = {
            -5: F.lit("Timecards,,"), -4: F.lit('"printed, by ""night"" shift",x'),
            -3: F.lit(""), -2: F.lit("Shift,W/C"), -1: head,
        }
        lines = both.select(*others, "e.line", "e.line_4").unionByName(_added(rows, around), allowMissingColumns=True)
        return _raw(t, "timecards", lines, ["sheet", *order])

    return landed_once(t, "timecard_extracts", build)


def strict(t: Tables, contract: Contract) -> DataFrame:
    """Raw cells of reports that begin with their header; of three, one has it in another order, one has more."""

    def build() -> DataFrame:
        view = views.TIMECARDS if contract is TIMECARDS else views.SCHEDULED_JOBS
        more = {} if contract is TIMECARDS else {"due": "CAST(CAST(l.l_shipdate AS DATE) AS STRING)"}
        rows = _with(t, view, more)
        known = [f.name for f in contract.fields if f.name in rows.columns]
        names, cells = contract.headers, _filled(contract, known)
        kind = F.col("report") % 3
        head = F.when(kind == 1, _header(names[::-1])).when(kind == 2, _header([*names, "More"])).otherwise(_header(names))
        body = rows.select("report", F.lit(0).alias("kind"), *views.LINE_ORDER, _line(cells).alias("line"))
        lines = body.unionByName(_added(rows, {-1: head}), allowMissingColumns=True)
        return _raw(t, contract.name, lines, list(views.LINE_ORDER))

    return landed_once(t, f"strict_{contract.name}", build)


def downtime(t: Tables) -> DataFrame:
    """Raw cells of downtime sheets: title and column names on top, a footer at the end."""

    def build() -> DataFrame:
        rows = _with(t, views.TIMECARDS, {})
        text = F.concat_ws(" - ", "wc", "wc_type")
        hours = F.when(F.col("line_1") % 3 == 0, F.lit("n.a.")).otherwise(F.col("prod_downtime_h").cast("string"))
        body = rows.select("report", F.lit(0).alias("kind"), *views.LINE_ORDER, _line([text, hours, F.lit("left over")]).alias("line"))
        around = {-2: F.lit("Down Time by WC"), -1: F.lit("Work Center,Hours"), 1: F.lit("Printed,99")}
        lines = body.unionByName(_added(rows, around), allowMissingColumns=True)
        return _raw(t, "downtime", lines, list(views.LINE_ORDER))

    return landed_once(t, "downtime_extracts", build)


def ladder(t: Tables, name: str, cells: DataFrame) -> DataFrame:
    """Raw cells of a wide sheet that went through CSV; a row ends with its last filled cell.

    A sheet is written in parts, so that no task has a whole one; only its first part has the header.
    """

    def build() -> DataFrame:
        quoted = F.transform("cells", lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")))
        line = F.regexp_replace(F.array_join(quoted, ","), ",+$", "")
        number = F.coalesce(F.regexp_extract("file", r"(\d+)$", 1).try_cast("int"), F.lit(0))
        part = F.coalesce(F.greatest(F.expr(f"row_no DIV {PART_ROWS}"), F.lit(0)), F.lit(0)).alias("part")
        lines = cells.select(number.alias("report"), part, F.col("row_no").alias("kind"), line.alias("line"))
        source = _written(lines, [], t.parts("part", PART_ROWS), ("report", "part"))
        raw = land_csv(t.spark, source, f"{source}-{name}")
        place = F.regexp_extract("file", r"/part=(\d+)/", 1).cast("bigint") * (1 << 32)
        file = F.regexp_replace("file", r"/part=\d+/[^/]*$", "")
        return raw.select(file.alias("file"), (place + F.col("row_no")).alias("row_no"), "cells")

    return landed_once(t, f"csv_{name}", build)
