"""Production efficiency, downtime, scrap and plan compliance.

A timecard repeats for every downtime reason of a timesheet. Reports marked
"per timesheet" count only the first row of each timesheet among the filtered rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import exact_mean, exact_sum, percent_or_zero
from shopledger.operators import (
    by_key,
    date_range,
    equal_to,
    in_list,
    keep_first,
    option_rows,
    sorted_by,
)
from shopledger.operators.filters import Dates, selected, within

ROW_ORDER = ("file", "row_no")
PLAN_MEASURES = ("to_make", "produced", "can_make", "remaining")


def filter_timecards(
    tc: DataFrame,
    dates: Dates | None = None,
    shifts: Sequence[str] | None = None,
    wc_types: Sequence[str] | None = None,
    wcs: Sequence[str] | None = None,
    *,
    end_of_day: bool = False,
) -> DataFrame:
    """Timecards in a date range, of some shifts, classes and work centres.

    An empty selection keeps no rows; ``None`` leaves the filter out.
    """
    rows = date_range(tc, "completed_on", dates, end_of_day=end_of_day)
    rows = in_list(rows, "shift", shifts)
    rows = in_list(rows, "wc_type", wc_types)
    return in_list(rows, "wc", wcs)


def timecard_options(
    tc: DataFrame,
    dates: Dates | None = None,
    shifts: Sequence[str] | None = None,
    wc_types: Sequence[str] | None = None,
) -> DataFrame:
    """Date bounds, shifts, classes and centres to choose from as ``(option, value)``.

    Each list depends on the choices before it; an empty choice leaves nothing.
    """
    in_dates = within("completed_on", dates)
    in_shifts = in_dates & selected("shift", shifts, empty="none")
    in_types = in_shifts & selected("wc_type", wc_types, empty="none")
    return option_rows(
        tc,
        {"shift": ("shift", in_dates), "wc_type": ("wc_type", in_shifts), "wc": ("wc", in_types)},
        ("completed_on", F.lit(True)),
    )


def plan_options(jobs: DataFrame, wc_type: str) -> DataFrame:
    """Work-centre classes, and the centres of one class, as ``(option, value)``."""
    mine = F.coalesce(F.col("wc_type") == F.lit(wc_type), F.lit(False))
    return option_rows(jobs, {"wc_type": ("wc_type", F.lit(True)), "wc": ("wc", mine)})


def repeated_reasons(reasons: DataFrame) -> DataFrame:
    """Reason ids that occur more than once; a usable catalogue has none."""
    counts = reasons.groupBy("reason_id").agg(F.count("*").alias("n"))
    return counts.where("n > 1").select("reason_id")


def per_timesheet(tc: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """The first row of each timesheet."""
    return keep_first(tc, ["timesheet_no"], order)


def kpis(tc: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Mean efficiency and OEE over all rows; quantity and idle hours per timesheet.

    The two kinds read different columns. Timesheets are cut to their first row in each map
    task before the shuffle, and everything is added up at once.
    """
    sheets = per_timesheet(tc.select("timesheet_no", "quantity", "nonprod_downtime_h", *order), order)
    rows = tc.select("efficiency", "oee").unionByName(
        sheets.select("quantity", "nonprod_downtime_h"), allowMissingColumns=True
    )
    return rows.agg(
        exact_mean(F.col("efficiency")).alias("mean_efficiency"),
        exact_mean(F.col("oee")).alias("mean_oee"),
        exact_sum(F.col("quantity")).alias("quantity"),
        exact_sum(F.col("nonprod_downtime_h")).alias("nonprod_downtime_h"),
    )


def run_rate(tc: DataFrame) -> DataFrame:
    """Mean expected and actual run rate per work centre that has both, long form, fastest expected first."""
    means = (
        tc.where(F.col("wc").isNotNull())
        .groupBy("wc")
        .agg(
            exact_mean(F.col("expected_run_rate")).alias("expected"),
            exact_mean(F.col("actual_run_rate")).alias("actual"),
        )
        .dropna(subset=["expected", "actual"])
    )
    ordered = sorted_by(means, "expected", "wc", descending=True)
    return ordered.unpivot("wc", ["expected", "actual"], "kind", "run_rate")


def distinct_by(tc: DataFrame, key: str, counted: str) -> DataFrame:
    """Distinct values of one column per key, fewest first."""
    return by_key(tc, key, counted, "distinct")


def filter_downtime(
    downtime: DataFrame,
    dates: Dates | None = None,
    shifts: Sequence[str] | None = None,
    wc_types: Sequence[str] | None = None,
    wcs: Sequence[str] | None = None,
) -> DataFrame:
    """Downtime rows; each filter acts only if the table has its column."""
    rows = downtime
    if "completed_on" in rows.columns:
        rows = date_range(rows, "completed_on", dates)
    for column, values in (("shift", shifts), ("wc_type", wc_types), ("wc", wcs)):
        if column in rows.columns:
            rows = in_list(rows, column, values)
    return rows


def downtime_by_wc(downtime: DataFrame, wcs: Sequence[str] | None = None) -> DataFrame:
    """Downtime hours per work centre, most first."""
    rows = filter_downtime(downtime, wcs=wcs)
    return by_key(rows, "wc", "downtime_h", "sum", descending=True)


def downtime_by_reason(
    downtime: DataFrame, reasons: DataFrame, wcs: Sequence[str] | None = None
) -> DataFrame:
    """Downtime hours per work centre and reason, with the reason's description.

    ``reasons`` is the ``(reason_id, description)`` catalogue with unique ids. It is
    joined to the grouped rows; Spark broadcasts it while it is small.
    """
    rows = filter_downtime(downtime, wcs=wcs).dropna(subset=["wc", "reason_id"])
    hours = rows.groupBy("wc", "reason_id").agg(exact_sum(F.col("downtime_h")).alias("downtime_h"))
    return hours.join(reasons.select("reason_id", "description"), "reason_id", "left").select(
        "wc", "reason_id", "downtime_h", "description"
    )


def filter_jobs(jobs: DataFrame, wc_type: str, wcs: Sequence[str] | None = None) -> DataFrame:
    """Scheduled jobs of one work-centre class; an empty list means all centres."""
    return in_list(equal_to(jobs, {"wc_type": wc_type}), "wc", wcs, empty="all")


def plan_compliance(
    jobs: DataFrame, wc_type: str, wcs: Sequence[str] | None = None
) -> DataFrame:
    """Plan quantities per work centre and produced in percent of planned, lowest first."""
    sums = _plan_sums(filter_jobs(jobs, wc_type, wcs), PLAN_MEASURES)
    percent = percent_or_zero(F.col("produced"), F.col("to_make"))
    return sorted_by(sums.withColumn("compliance_pct", percent), "compliance_pct", "wc")


def missing_parts(jobs: DataFrame, wc_type: str, wcs: Sequence[str] | None = None) -> DataFrame:
    """Makeable minus remaining pieces per work centre, lowest first."""
    sums = _plan_sums(filter_jobs(jobs, wc_type, wcs), ("can_make", "remaining"))
    missing = F.col("can_make") - F.col("remaining")
    return sorted_by(sums.withColumn("missing_parts", missing), "missing_parts", "wc")


def plan_detail(jobs: DataFrame, wc_type: str, wcs: Sequence[str] | None = None) -> DataFrame:
    """The filtered jobs with their plan quantities."""
    return filter_jobs(jobs, wc_type, wcs).select(
        "wc_type", "wc", "job_no", "item", "to_make", "can_make", "remaining", "produced"
    )


def _plan_sums(jobs: DataFrame, measures: Sequence[str]) -> DataFrame:
    grouped = jobs.where(F.col("wc").isNotNull()).groupBy("wc")
    return grouped.agg(*[exact_sum(F.col(m)).alias(m) for m in measures])
