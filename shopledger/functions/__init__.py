"""Column-level building blocks: cleaning, exact measures, calendar, text."""

from shopledger.functions.calendar import (
    as_of_timestamp,
    month_label,
    month_name,
    month_start,
    period_label,
    period_start,
    sunday_week,
    week_start,
    whole_days,
)
from shopledger.functions.cleaning import (
    NULL_TOKENS,
    clean_cell,
    clean_header,
    strip_ws,
    to_number,
    to_time,
)
from shopledger.functions.measures import (
    exact_mean,
    exact_sum,
    integer_text,
    money_text,
    number_text,
    percent_or_zero,
    rint_to,
)
from shopledger.functions.text import NO_PO, NO_VENDOR, code_part, po_number, vendor_name

__all__ = [
    "NO_PO",
    "NO_VENDOR",
    "NULL_TOKENS",
    "as_of_timestamp",
    "clean_cell",
    "clean_header",
    "code_part",
    "exact_mean",
    "exact_sum",
    "integer_text",
    "money_text",
    "month_label",
    "month_name",
    "month_start",
    "number_text",
    "percent_or_zero",
    "period_label",
    "period_start",
    "po_number",
    "rint_to",
    "strip_ws",
    "sunday_week",
    "to_number",
    "to_time",
    "vendor_name",
    "week_start",
    "whole_days",
]
